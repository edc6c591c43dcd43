"""Fuzzy tags of free-text descriptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def _masks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each character of the long text the positions it holds in the short one, as bits."""
    out = np.zeros(len(long), dtype=object if len(short) > 62 else np.uint64)
    one = 1 if out.dtype == object else np.uint64(1)
    for i, ch in enumerate(short):
        out[long == ch] |= one << (i if out.dtype == object else np.uint64(i))
    return out


def _count(bits: np.ndarray, m: int) -> np.ndarray:
    """Zero bits among the lowest m."""
    if bits.dtype == object:
        return np.array([m - bin(int(b) & ((1 << m) - 1)).count("1") for b in bits])
    kept = bits & np.uint64((1 << m) - 1)
    return m - np.bitwise_count(kept).astype(np.int64)


def _one_way(short: str, long: str) -> float:
    """Best window of the long text, windows cut off at either end included.

    The longest common subsequence of every window is found at once: one step per
    character of the short text, each step a few operations over all windows.
    """
    a, b = _codes(short), _codes(long)
    m, n = len(a), len(b)
    masks = _masks(a, b)
    full = (1 << m) - 1 if masks.dtype == object else np.uint64((1 << m) - 1)

    def walk(state, mask):
        used = state & mask
        return ((state + used) | (state - used)) & full

    state = np.full(n - m + 1, full, dtype=masks.dtype)
    for j in range(m):
        state = walk(state, masks[j:j + n - m + 1])
    best = 100.0 * _count(state, m).max() / m
    edges = [masks, _masks(a[::-1], b[::-1])]
    for mk in edges:
        state = np.full(1, full, dtype=masks.dtype)
        for k in range(1, m):
            state = walk(state, mk[k - 1:k])
            best = max(best, 200.0 * float(_count(state, m)[0]) / (m + k))
    return float(best)


def partial_ratio(s1: str, s2: str) -> float:
    """Best Indel similarity (0..100) of the shorter text against windows of the longer."""
    if not s1 or not s2:
        return 100.0 if s1 == s2 else 0.0
    short, long = (s1, s2) if len(s1) <= len(s2) else (s2, s1)
    if short in long:
        return 100.0
    best = _one_way(short, long)
    if len(short) == len(long):
        best = max(best, _one_way(long, short))
    return best


#: Characters of a text from which on its letters are not counted before it is scored.
LONG_TEXT = 256
#: Windows whose letters one numpy step counts: arrays of a byte each, which stay in the cache of a core.
SLICE_CHARS = 1 << 16
#: Longest phrase whose positions fit one machine word; counts of letters in a window then fit a byte too.
LONGEST_PHRASE = 62


def _rich_windows(body: np.ndarray, wanted: Mapping[str, int]) -> dict[str, np.ndarray]:
    """For each phrase the starts of the windows of its length, without a zero, that have at least the wanted number of letters in common with it, whatever their order.

    Counts of a letter in windows of 1, 2, 4, .. characters are sums of two neighbours; a phrase's length is put together from them, so all phrases share them.
    """
    found: dict[str, list[np.ndarray]] = {p: [] for p in wanted}
    for low in range(0, len(body), SLICE_CHARS):
        part = body[low:low + SLICE_CHARS + LONGEST_PHRASE - 1]
        doubled: dict[int, list[np.ndarray]] = {}

        def within(code: int, m: int) -> np.ndarray:
            levels = doubled.setdefault(code, [(part == code).view(np.uint8)])  # noqa: B023
            while 1 << len(levels) <= m:
                last, half = levels[-1], 1 << len(levels) - 1
                levels.append(last[:-half] + last[half:])
            total, at, n = None, 0, len(part) - m + 1  # noqa: B023
            for k, level in enumerate(levels):
                if m >> k & 1:
                    total = level[at:at + n] if total is None else total + level[at:at + n]
                    at += 1 << k
            return total

        for phrase, least in wanted.items():
            m = len(phrase)
            if len(part) < m:
                continue
            common = np.zeros(len(part) - m + 1, np.uint8)
            for letter in sorted(set(phrase)):
                common += np.minimum(within(ord(letter), m), np.uint8(phrase.count(letter)))
            at = np.flatnonzero(common[:SLICE_CHARS] >= least)
            found[phrase].append(low + at[within(0, m)[at] == 0])
    return {p: np.concatenate(v) if v else np.zeros(0, np.int64) for p, v in found.items()}


def _long_hits(texts: Sequence[str], phrases: Sequence[str], threshold: float) -> np.ndarray:
    """Whether each of the phrases reaches ``threshold`` in each of the texts (ASCII, no zero characters) that are longer than it; False for shorter ones.

    A window's letters in common with the phrase bound its score. Only windows whose bound reaches the threshold are scored, all of them at once, bit-parallel.
    """
    body = np.frombuffer(("\0".join(texts) + "\0").encode("ascii"), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    out = np.zeros((len(texts), len(phrases)), bool)
    need = {p: next(c for c in range(len(p) + 2) if c > len(p) or 100.0 * c / len(p) >= threshold) for p in phrases}
    rich = _rich_windows(body, need)
    one = np.uint64(1)

    def table(p: str) -> np.ndarray:
        masks = np.zeros(256, np.uint64)
        for i, ch in enumerate(p):
            masks[ord(ch)] |= one << np.uint64(i)
        return masks

    for number, phrase in enumerate(phrases):
        m, hit = len(phrase), out[:, number]
        full = np.uint64((1 << m) - 1)

        def walk(state, mask):
            used = state & mask
            return ((state + used) | (state - used)) & full  # noqa: B023

        at = rich[phrase]
        own = np.searchsorted(first, at, "right") - 1
        at, own = at[sizes[own] > m], own[sizes[own] > m]
        masks, state = table(phrase), np.full(len(at), full, np.uint64)
        for j in range(m):
            state = walk(state, masks[body[at + j]])
        hit[own[100.0 * _count(state, m) / m >= threshold]] = True
        # Windows cut off at either end.
        longer = np.flatnonzero(sizes > m)
        for spots, mask, step in ((first[longer], masks, 1), ((first + sizes - 1)[longer], table(phrase[::-1]), -1)):
            state = np.full(len(longer), full, np.uint64)
            for k in range(1, m):
                state = walk(state, mask[body[spots + step * (k - 1)]])
                hit[longer] |= 200.0 * _count(state, m) / (m + k) >= threshold
    return out


def phrase_hits(texts: Sequence[str], phrases: Sequence[str], threshold: float) -> list[list[bool]]:
    """For each text whether the partial ratio of each phrase is at least ``threshold``."""
    out = np.zeros((len(texts), len(phrases)), bool)
    short = [0 < len(p) <= LONGEST_PHRASE and p.isascii() for p in phrases]
    plain = [t.isascii() and "\0" not in t for t in texts]
    for i, t in enumerate(texts):
        for k, p in enumerate(phrases):
            if not (plain[i] and short[k] and len(t) > len(p)):
                out[i, k] = partial_ratio(t, p) >= threshold
    least = min((len(p) for p, s in zip(phrases, short, strict=True) if s), default=None)
    some = [i for i, t in enumerate(texts) if least is not None and plain[i] and len(t) > least]
    if some:
        own = np.flatnonzero(short)
        out[np.ix_(some, own)] |= _long_hits([texts[i] for i in some], [phrases[k] for k in own], threshold)
    return out.tolist()


def close_phrases(text: Column, phrases: Sequence[str], threshold: float) -> Column:
    """Array of booleans, one per phrase, for a normalized text. Equal texts of a batch are scored once."""
    wanted, limit = list(phrases), float(threshold)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def close(col: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(col)
        found = phrase_hits(list(texts), wanted, limit)
        return pd.Series([found[c] if c >= 0 else None for c in codes], dtype=object)

    return close(text)


def _close(df: DataFrame, text: str, phrases: Sequence[str], threshold: float, out: str) -> DataFrame:
    """``df`` with an array of booleans: which of the phrases each text comes close to. Blank texts come close to none.

    Texts are scored where their rows lie. Rows are dealt anew before that, since a text costs much for its bytes; nothing else is shuffled.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = df.repartition(tasks).withColumn("__t", F.nullif(X.normalize(text), F.lit("")))
    normal = [_norm(p) for p in phrases]
    none = F.array(*[F.lit(False) for _ in normal])
    held = F.array(*[F.contains("__t", F.lit(p)) if p else F.lit(False) for p in normal])
    if threshold >= 100.0:
        # A full score is the shorter of the two inside the longer one, and more is never reached.
        whole = F.array(*[F.contains("__t", F.lit(p)) | F.contains(F.lit(p), F.col("__t")) if p else F.lit(False) for p in normal]) if threshold == 100.0 else none
        return norm.withColumn(out, F.when(F.col("__t").isNull(), none).otherwise(whole)).drop("__t")
    # A text that holds each phrase as it is needs no score; nor does one that shares too few letters with all of them: the shorter of the two must have
    # threshold / (200 - threshold) of its length in common with the other.
    share = threshold / (200.0 - threshold)
    size = F.length("__t")
    may = [size - F.length(F.translate("__t", "".join(sorted(set(p))), "")) >= share * F.least(size, F.lit(len(p))) for p in normal]
    ask = ~F.forall("__held", lambda h: h) & ((size > LONG_TEXT) | reduce(Column.__or__, may))
    known = norm.withColumn("__held", held).withColumn("__ask", F.when(ask, F.col("__t")))
    scored = known.withColumn("__s", close_phrases(F.col("__ask"), normal, threshold))
    return scored.withColumn(out, F.coalesce("__s", F.when(F.col("__t").isNotNull(), F.col("__held")), none)).drop("__t", "__held", "__ask", "__s")


def _named(flags: Column, names: Sequence[str]) -> Column:
    """The names whose flag is set."""
    hit = F.zip_with(F.array(*[F.lit(n) for n in names]), flags, lambda n, f: F.when(f, n))
    return F.filter(hit, lambda n: n.isNotNull())


def tag_phrases(df: DataFrame, text: str, phrases: Sequence[str] = tuple(X.UNCERTAINTY_PHRASES), threshold: float = X.MATCH_THRESHOLD,
                out: str = "uncertainty") -> DataFrame:
    """Sorted array of the phrases a description comes close to."""
    return _close(df, text, phrases, threshold, "__f").withColumn(out, F.array_sort(_named(F.col("__f"), phrases))).drop("__f")


def _synonyms(synonyms: Mapping[str, Sequence[str]]) -> tuple[list[str], list[str]]:
    """Each synonym and the umbrella term that it stands for."""
    flat = [(s, u) for u, many in synonyms.items() for s in many]
    return [s for s, _ in flat], [u for _, u in flat]


def tag_synonyms(df: DataFrame, text: str, synonyms: Mapping[str, Sequence[str]] = X.CATEGORY_SYNONYMS, threshold: float = X.MATCH_THRESHOLD,
                 out: str = "category") -> DataFrame:
    """Sorted array of the umbrella terms one of whose synonyms is close."""
    phrases, owners = _synonyms(synonyms)
    return _close(df, text, phrases, threshold, "__f").withColumn(out, F.array_sort(F.array_distinct(_named(F.col("__f"), owners)))).drop("__f")


def describe_polygons(df: DataFrame, description: str = "description") -> DataFrame:
    """Certainty, uncertainty phrases and category of each description; no description counts as a blank one. One pass scores all phrases."""
    phrases, owners = _synonyms(X.CATEGORY_SYNONYMS)
    flags = list(X.UNCERTAINTY_PHRASES)
    tagged = _close(df.withColumn("__d", F.coalesce(description, F.lit(""))), "__d", [*flags, *phrases], X.MATCH_THRESHOLD, "__f")
    terms = F.array_sort(F.array_distinct(_named(F.slice("__f", len(flags) + 1, len(phrases)), owners)))
    return tagged.withColumn("__c", terms).withColumns({
        "certainty": X.certainty_of("__d"),
        "uncertainty_explanation": F.array_join(F.array_sort(_named(F.slice("__f", 1, len(flags)), flags)), ";"),
        "category": F.when(F.size("__c") > 0, F.array_join("__c", ";")).otherwise(X.DEFAULT_CATEGORY),
    }).drop("__d", "__f", "__c")


def _norm(s: str) -> str:
    return "".join(ch for ch in s.lower().strip() if ch.isspace() or "a" <= ch <= "z")
