"""Text analysis as column expressions.

Segmentation, lower case, the length filter and stop words stay in the JVM. Stems and Unicode words are Arrow functions
that work on each batch's distinct tokens only.

Null and empty texts have no tokens; the order and repetition of tokens are kept.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.porter2 import stem
from tessera.plans.settings import TokenizerConfig

#: Bytes of text whose words are cut at once, which bounds a task's memory; a single text may have more.
SLICE_BYTES = 1 << 20
WORD = r"[\p{L}\p{N}]+"


def default_stopwords() -> tuple[str, ...]:
    """A common English list, in lower case; pass another as ``TokenizerConfig.stopwords``."""
    return tuple(sorted(set(
        "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down "
        "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor "
        "not of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these "
        "they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split()
    )))


def stopwords_of(cfg: TokenizerConfig) -> tuple[str, ...]:
    return default_stopwords() if cfg.stopwords is None else tuple(w.lower() for w in cfg.stopwords)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unicode_words(texts: pa.Array) -> pa.Array:
    import regex

    cut = regex.compile(r"(?V1)(?w)\b")
    alnum = regex.compile(r"[\p{L}\p{N}]")
    size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    out, at = [], 0
    while at < len(texts):  # words are Python's strings for one slice at a time
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        out.append(pa.array([[] if t is None else [x for x in cut.split(t) if x and alnum.search(x)] for t in texts.slice(at, to - at).to_pylist()], pa.list_(pa.string())))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pa.Array) -> pa.Array:
    code = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(x) for x in code.dictionary.to_pylist()], pa.string())
    size = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), stems.take(code.indices))


def words(text: Column, cfg: TokenizerConfig) -> Column:
    """Segmentation only."""
    t = F.coalesce(text, F.lit(""))
    return _unicode_words(t) if cfg.mode == "uax29" else F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def tokens(text: Column, cfg: TokenizerConfig | None = None) -> Column:
    """The analysed tokens: words, lower case, length in UTF-8 bytes, stop words, stems."""
    cfg = cfg or TokenizerConfig()
    out = words(text, cfg)
    if cfg.lowercase:
        out = F.transform(out, F.lower)
    stop = stopwords_of(cfg) if cfg.remove_stopwords else ()

    def keep(t: Column) -> Column:
        ok = F.octet_length(t).between(cfg.min_len, cfg.max_len)
        return ok & ~t.isin(*stop) if stop else ok

    out = F.filter(out, keep)
    return _stems(out) if cfg.stem else out


@cache
def letters() -> np.ndarray:
    """For each code point whether it belongs to a word, as the JVM's classes have it, in packed bits."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pattern = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(f"(?:{WORD})")
    others = pattern.matcher("".join(map(chr, every))).replaceAll("")
    found = np.zeros(0x110000, bool)
    found[every] = True
    found[[ord(c) for c in others]] = False
    return np.packbits(found)


@cache
def _lowered() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, where that is one of as many bytes; and whether it is another, or depends on the word."""
    small, other = np.arange(0x110000, dtype=np.int32), np.zeros(0x110000, bool)
    for c in range(128, 0x110000):
        if not 0xD800 <= c < 0xE000 and (low := chr(c).lower()) != chr(c):
            if len(low) == 1 and len(low.encode()) == len(chr(c).encode()) and c != 0x3A3:
                small[c] = ord(low)
            else:
                other[c] = True
    return small, other


class Cutter:
    """``tokens`` in mode 'simple' for many texts at once, in a task: words are cut by their bytes, and what is done to a word is done to
    each distinct one."""

    def __init__(self, cfg: TokenizerConfig, packed: np.ndarray):
        self.cfg, self.letter, self.stop = cfg, np.unpackbits(packed).astype(bool), pa.array(stopwords_of(cfg) if cfg.remove_stopwords else (), pa.string())
        self.byte = np.append(self.letter[:128], np.zeros(128, bool)).tobytes()
        self.lower = bytes(range(256))
        if cfg.lowercase:
            self.lower = self.lower[:65] + self.lower[97:123] + self.lower[91:]
            self.small, self.other = _lowered()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(the place of each token among the terms, the terms, the number of tokens of each text)."""
        off, buf = _bytes(texts)
        raw, other = buf.tobytes(), False
        inside, low = (np.frombuffer(bytearray(raw.translate(x)), np.uint8) for x in (self.byte, self.lower))
        inside = inside.view(bool)
        lead = np.flatnonzero(buf >= 0xC0)
        first = buf[lead].astype(np.int32)
        width = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        for w, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = lead[width == w]
            point = buf[at].astype(np.int32) & bits
            for j in range(1, w):
                point = point << 6 | (buf[at + j] & 0x3F)
            some = self.letter[point]
            at, point = at[some], point[some]
            for j in range(w):
                inside[at + j] = True
            if self.cfg.lowercase:
                other |= bool(self.other[point].any())
                new = self.small[point]
                moved = new != point
                at, new = at[moved], new[moved]
                for j in range(w - 1, -1, -1):
                    low[at + j] = (new & 0x3F | 0x80) if j else (new | (0xFF00 >> w & 0xFF))
                    new = new >> 6
        edges = np.flatnonzero(np.concatenate(([False], inside)) != np.append(inside, False))
        met = np.unique(off[1:-1])  # a word ends with its text
        met = met[(met > 0) & (met < len(buf))]
        met = met[inside[met - 1] & inside[met]]
        edges = np.insert(edges, np.repeat(np.searchsorted(edges, met), 2), np.repeat(met, 2))
        begins, width = edges[::2], edges[1::2] - edges[::2]
        if not other:  # no word changes its length
            kept = (width >= self.cfg.min_len) & (width <= self.cfg.max_len)
            begins, width = begins[kept], width[kept]
        size = np.diff(np.searchsorted(begins, off))
        code, words = _distinct(low, begins, width)
        terms, keep = self._terms(words, other)
        if not keep.all():
            kept = keep[code]
            sums = np.append(0, np.cumsum(kept))
            size, code = np.diff(sums[np.append(0, np.cumsum(size))]), code[kept]
        if terms is not words:  # distinct words may be one term
            terms = terms.dictionary_encode()
            code, terms = np.asarray(terms.indices, np.int64)[code], terms.dictionary
        return code, terms, size

    def _terms(self, words: pa.Array, other: bool) -> tuple[pa.Array, np.ndarray]:
        """The term of each word, and whether it is kept. ``other``: there are letters in them that aren't in lower case yet."""
        other = ~np.asarray(pc.string_is_ascii(words)) if other else np.zeros(len(words), bool)
        if other.any():
            words = pc.replace_with_mask(words, pa.array(other), pa.array([w.lower() for w in words.filter(pa.array(other)).to_pylist()], pa.string()))
        size = np.asarray(pc.binary_length(words))
        keep = (size >= self.cfg.min_len) & (size <= self.cfg.max_len)
        if len(self.stop):
            keep &= ~np.asarray(pc.is_in(words, value_set=self.stop))
        return (pa.array([stem(w) for w in words.to_pylist()], pa.string()) if self.cfg.stem else words), keep


def _distinct(buf: np.ndarray, begins: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(the place of each word among the distinct ones, these). Most words are of eight bytes at most, which are one number; no
    letter is a zero byte."""
    eight = np.ndarray(len(buf), "<u8", np.append(buf, np.zeros(8, np.uint8)).data, 0, (1,))[begins] if len(begins) else np.zeros(0, "<u8")
    short = width <= 8
    found = pa.array(eight[short] & (np.uint64(2**64 - 1) >> (64 - 8 * width[short]).astype(np.uint64))).dictionary_encode()
    each = np.asarray(found.dictionary, "<u8").view(np.uint8).reshape(-1, 8)
    code = np.empty(len(begins), np.int64)
    code[short] = np.asarray(found.indices)
    begins, width = begins[~short], width[~short]
    ends = np.append(0, np.cumsum(width))
    longer = _strings(buf[np.repeat(begins - ends[:-1], width) + np.arange(ends[-1])], ends).dictionary_encode()
    code[~short] = len(each) + np.asarray(longer.indices)
    return code, pa.concat_arrays([_strings(each[each > 0], np.append(0, np.cumsum((each > 0).sum(1)))), longer.dictionary])


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of texts; nulls are empty, and bytes that are no text are no letters."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    try:
        texts.cast(pa.string()).validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.binary())
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return off - off[0], (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[off[0] : off[-1]]


def analyse(text: str, cfg: TokenizerConfig | None = None) -> list[str]:
    """The tokens of one text on the driver, as ``tokens`` gives them: for query strings."""
    import regex

    cfg = cfg or TokenizerConfig()
    if cfg.mode == "uax29":
        out = [x for x in regex.split(r"(?V1)(?w)\b", text or "") if x and regex.search(r"[\p{L}\p{N}]", x)]
    else:
        out = regex.findall(WORD, text or "")
    if cfg.lowercase:
        out = [t.lower() for t in out]
    stop = set(stopwords_of(cfg)) if cfg.remove_stopwords else ()
    out = [t for t in out if cfg.min_len <= len(t.encode()) <= cfg.max_len and t not in stop]
    return [stem(t) for t in out] if cfg.stem else out


def term_frequencies(text: str, cfg: TokenizerConfig | None = None) -> dict[str, int]:
    return dict(Counter(analyse(text, cfg)))
