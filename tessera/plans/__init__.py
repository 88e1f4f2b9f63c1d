"""Settings, maintenance plans and the engine facade."""
