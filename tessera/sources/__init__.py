"""Tables, logs, segments and snapshots on storage."""
