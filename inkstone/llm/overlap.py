"""Same or near-same records across splits (problem 5).

Evaluation strings are cut into one segment more than there can be damages, so a near-same training string holds at
least one segment undamaged, at a position the edit bound allows. Two forms of a string are cut: the letters as
written, which the training string holds from some word on as a ring (damages: the edits and the seam where the order
of words was turned), and the letters of the sorted words (damages: an edited word leaves one place and enters
another), which no change of word order alters. Strings too short for segments meet on their letters in order less up
to two. Each meeting is verified by banded dynamic programming over the words the two don't share.

Records must agree on a key as well. Rows are dealt to tasks by key, those of a hot key in slices; inside a task the
segments are an index that the training substrings are looked up in, so substrings are never shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkstone.llm.canon import DOT, canonical
from inkstone.session import materialize, slots

EDITS = 2
#: Segments of the letters as written (edits and one seam), and of the sorted words (two places an edit).
SEGMENTS, SORTED_SEGMENTS = EDITS + 2, 2 * EDITS + 1
#: Evaluation strings of fewer letters meet on their letters less up to ``EDITS``.
SHORT = 12
LONGEST_SMALL = 6
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Letters and digits of the consistent form in lower case, cut at everything else."""
    return _WORD.findall((canonical(text) or "").lower().replace(DOT, " "))


def segments(text: str, count: int) -> list[tuple[int, str]]:
    """(position, stretch) of ``count`` stretches of nearly equal length that tile the text."""
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in itertools.pairwise(cuts)]


def segment_lengths(length: int, count: int) -> set[int]:
    """Lengths of the segments of every text at most ``EDITS`` letters longer or shorter."""
    near = range(max(SHORT, length - EDITS), length + EDITS + 1)
    return {n for size in near for n in (size // count, -(-size // count))}


def fewer_letters(text: str) -> set[str]:
    """The letters in order, less any 0 to ``EDITS`` of them: texts that few edits apart share one, however ordered."""
    letters = "".join(sorted(text))
    out = level = {letters}
    for _ in range(EDITS):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def banded(a: str, b: str, k: int) -> list[tuple[int, int, bool]] | None:
    """(position in a, in b, whether one letter stands for another) of at most ``k`` edits that turn a into b; None if
    it takes more."""
    la, lb = len(a), len(b)
    if abs(la - lb) > k:
        return None
    far = k + 1
    rows = [{j: j for j in range(min(lb, k) + 1)}]
    for i in range(1, la + 1):
        before, row = rows[-1], {}
        for j in range(max(0, i - k), min(lb, i + k) + 1):
            best = i if j == 0 else min(before.get(j - 1, far) + (a[i - 1] != b[j - 1]), before.get(j, far) + 1, row.get(j - 1, far) + 1)
            row[j] = best
        if min(row.values()) > k:
            return None
        rows.append(row)
    if rows[la].get(lb, far) > k:
        return None
    out, i, j = [], la, lb
    while i or j:
        here = rows[i][j]
        if i and j and rows[i - 1].get(j - 1, far) + (a[i - 1] != b[j - 1]) == here:
            if a[i - 1] != b[j - 1]:
                out.append((i - 1, j - 1, True))
            i, j = i - 1, j - 1
        elif i and rows[i - 1].get(j, far) + 1 == here:
            out.append((i - 1, min(j, lb - 1), False))
            i -= 1
        else:
            out.append((min(i, la - 1), j - 1, False))
            j -= 1
    return out


def _at(tokens: tuple[str, ...], position: int) -> str:
    for token in tokens:
        if position < len(token):
            return token
        position -= len(token)
    return tokens[-1] if tokens else ""


def without_small(tokens: list[str], small: frozenset[str]) -> list[tuple[list[str], int]]:
    """The tokens as they are, and without one small word (whole, grown on to a neighbour, or lacking a letter), with
    the edits that took."""
    out = [(tokens, 0)]
    for i, token in enumerate(tokens):
        rest = tokens[:i] + tokens[i + 1 :]
        if token in small:
            out.append((rest, 0))
            continue
        for s in small:
            if len(s) > 1 and len(token) > len(s) and (token.startswith(s) or token.endswith(s)):
                out.append((tokens[:i] + [token.removeprefix(s) if token.startswith(s) else token.removesuffix(s)] + tokens[i + 1 :], 0))
            elif len(s) > 1 and len(s) - 1 <= len(token) <= len(s) and banded(token, s, 1):
                out.append((rest, 1))
    return out


def _orders(a: list[str], b: list[str]) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Orders of two lists of words to compare letter by letter: all of them for the few words two near-same texts
    don't share, else all turns."""
    if max(len(a), len(b)) <= 4:
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        for y in itertools.permutations(short) if len(short) <= 3 else [tuple(short)]:
            for x in itertools.permutations(long):
                yield (x, y) if long is a else (y, x)
    else:
        for i in range(max(1, len(b))):
            yield tuple(a), tuple(b[i:] + b[:i])
        for i in range(1, len(a)):
            yield tuple(a[i:] + a[:i]), tuple(b)


def _match(a: list[str], b: list[str], k: int) -> tuple[int, list[tuple[str, str]]] | None:
    """Least edits between a and b in any order of words, with the words in which one letter stands for another; of
    equal numbers the one with fewest such letters."""
    apart = Counter("".join(a))
    apart.subtract("".join(b))
    more, less = sum(n for n in apart.values() if n > 0), -sum(n for n in apart.values() if n < 0)
    if max(more, less) > k:
        return None
    shared = Counter(a) & Counter(b)
    rest = []
    for tokens in (a, b):
        left = Counter(shared)
        rest.append([t for t in tokens if not (left[t] > 0 and not left.subtract([t]))])
    if max(map(len, rest)) > 4:
        rest = [a, b]  # without spaces, say: shared words may lie inside others
    best = None
    for x, y in _orders(*rest):
        found = banded("".join(x), "".join(y), k)
        if found is None:
            continue
        swaps = [(_at(x, i), _at(y, j)) for i, j, swapped in found if swapped]
        if best is None or (len(found), len(swaps)) < (best[0], len(best[1])):
            best = len(found), swaps
            if len(found) <= max(more, less) and not swaps:
                break
    return best


def near_same(a: list[str], b: list[str], small: frozenset[str] = frozenset()) -> list[tuple[str, str]] | None:
    """The pairs of words in which one letter stands for another ([] if there are none); None for texts that aren't
    near-same: over ``EDITS`` edits apart, or edited in half of their letters or more."""
    best = None
    for x, cost in without_small(a, small):
        for y, more in without_small(b, small):
            if cost + more > EDITS or len(x) < len(a) and len(y) < len(b):
                continue  # one small word in all
            found = _match(x, y, EDITS - cost - more)
            size = max(len("".join(x)), len("".join(y)))
            if found is None or 2 * (edits := found[0] + cost + more) >= size:
                continue
            if best is None or (edits, len(found[1])) < (best[0], len(best[1])):
                best = edits, found[1]
                if not edits:
                    return []
    return None if best is None else best[1]


def meetings(left: list[tuple[int, list[str]]], right: list[tuple[int, list[str]]], small: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Positions (in left, in right) of texts, given as (group, words), that share a segment in one group."""
    written: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    plain: dict[tuple, list[int]] = defaultdict(list)
    sizes: dict[tuple, set[int]] = defaultdict(set)  # lengths of the segments there are: no others are looked up
    for e, (group, tokens) in enumerate(left):
        for variant, _ in without_small(tokens, small):
            text = "".join(variant)
            if len(text) < SHORT:
                for x in fewer_letters(text):
                    plain[group, "f", x].append(e)
                continue
            for at, x in segments(text, SEGMENTS):
                written[group, x].append((e, at))
                sizes[group, "w"].add(len(x))
            for _, x in segments("".join(sorted(variant)), SORTED_SEGMENTS):
                plain[group, "s", x].append(e)
                sizes[group, "s"].add(len(x))
    known = {g for g, _ in left}
    for t, (group, tokens) in enumerate(right):
        if group not in known:
            continue
        found: set[int] = set()
        for variant, _ in without_small(tokens, small):
            text = "".join(variant)
            n = len(text)
            if n < SHORT + EDITS:
                for x in fewer_letters(text):
                    found.update(plain.get((group, "f", x), ()))
            if n < SHORT - EDITS:
                continue
            starts = list(itertools.accumulate((len(w) for w in variant), initial=0))
            turns = {(s + d) % n for s in starts for d in range(-EDITS, EDITS + 1)}
            ring = text + text
            for size in segment_lengths(n, SEGMENTS) & sizes.get((group, "w"), set()):
                for i in range(n):
                    for e, at in written.get((group, ring[i : i + size]), ()):
                        if (i - at) % n in turns:
                            found.add(e)
            ordered = "".join(sorted(variant))
            for size in segment_lengths(n, SORTED_SEGMENTS) & sizes.get((group, "s"), set()):
                for i in range(n - size + 1):
                    found.update(plain.get((group, "s", ordered[i : i + size]), ()))
        for e in found:
            yield e, t


@F.pandas_udf(ArrayType(StringType()))
def words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(words)


def small_words(evaluation: DataFrame, training: DataFrame, least_keys: int = 2, share: float = 0.004) -> list[str]:
    """Words of at most ``LONGEST_SMALL`` letters that texts gain or lose without asking for anything else.

    Such a word is the only difference of two records of one key under ``least_keys`` keys, and under ``share`` of the
    keys that use it. Takes (``key``, ``w`` words) twice. What comes to the driver are these words alone.
    """
    both = evaluation.select("key", "w", F.lit(0).alias("side")).unionByName(training.select("key", "w", F.lit(1).alias("side")))
    bag = both.select("key", "side", F.xxhash64("key", F.array_sort("w")).alias("h"))
    without = lambda i: F.array_sort(F.filter("w", lambda _, j: j != i))
    gaps = F.filter(F.transform("w", lambda x, i: F.when(F.length(x) <= LONGEST_SMALL, F.struct(x.alias("word"), F.xxhash64("key", without(i)).alias("h")))), lambda s: s.isNotNull())
    dropped = both.select("key", (1 - F.col("side")).alias("side"), F.inline(gaps))
    lone = dropped.join(bag.select("h", "side").distinct(), ["h", "side"], "left_semi").groupBy("word").agg(F.countDistinct("key").alias("lone")).where(F.col("lone") >= least_keys)
    used = both.select("key", F.explode("w").alias("word")).groupBy("word").agg(F.approx_count_distinct("key").alias("n"))
    return sorted(r["word"] for r in lone.join(used, "word").where(F.col("lone") >= share * F.col("n")).select("word").collect())


def known_words(asked: DataFrame, used: DataFrame, known_in: int, share: float) -> DataFrame:
    """The ``word``s of ``asked`` that are words of their own, from the distinct (``key``, ``word``) in ``used``.

    They occur under ``known_in`` keys at least, and under at least ``share`` of the keys of the commonest word one edit
    away: typing errors recur as the tables grow, but stay a small share of the word they spoil.
    """
    counts = materialize(used.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    forms = F.expr("explode(array_append(transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substring(word, i + 1))), word))")
    mine = asked.join(counts, "word").where(F.col("n") >= known_in).select("word", "n")
    others = counts.select(F.col("word").alias("other"), F.col("n").alias("n_other"), forms.alias("form"))
    near = mine.select("word", forms.alias("form")).distinct().join(others, "form").where(F.levenshtein("word", "other") == 1)
    commonest = near.groupBy("word").agg(F.max("n_other").alias("most"))
    return mine.join(commonest, "word", "left").where(F.col("n") >= share * F.coalesce("most", F.lit(0))).select("word")


def _dealt(evaluation: DataFrame, training: DataFrame, rows_per_slice: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``bucket`` and a ``part``: every two rows of one key meet in exactly one part."""
    sizes = evaluation.groupBy("key").agg(F.count("*").alias("n")).join(training.groupBy("key").agg(F.count("*").alias("m")), "key")
    slices = sizes.select("key", *[F.ceil(F.col(c) / rows_per_slice).cast("int").alias(c) for c in ("n", "m")])
    out = []
    for df, own, other in ((evaluation, "n", "m"), (training, "m", "n")):
        mine, theirs = F.pmod(F.xxhash64("q"), F.col(own)).cast("int"), F.sequence(F.lit(0), F.col(other) - 1)
        cut = df.join(slices, "key").withColumn("mine", mine).withColumn("theirs", F.explode(theirs))
        part = F.xxhash64("key", *(("mine", "theirs") if own == "n" else ("theirs", "mine")))
        out.append(cut.select("q", "key", "w", part.alias("part"), F.pmod(part, F.lit(buckets)).cast("int").alias("bucket")))
    return out[0], out[1]


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, known_in: int = 3, share: float = 0.02, rows_per_slice: int = 5_000, rows_per_bucket: int = 20_000, small: list[str] | None = None) -> DataFrame:
    """(``a``, ``b``): ids of near-same records of the two splits that agree on their key.

    Both take (``q`` id, ``key``, ``text``). Rows with a null id, key or text, and texts without a letter or digit, take
    no part; repeated rows count once. A letter that turns one known word into another asks about another thing and
    makes no pair; a word is known when it occurs under at least ``known_in`` keys of all rows of both splits, and
    under ``share`` of those of any word one edit away (``known_words``). ``small`` are words that may be added; they
    are learned from both splits unless given (``small_words``). A task holds about ``rows_per_bucket`` rows; of a key
    with more than ``rows_per_slice`` rows, slices of both sides meet each other.
    """
    usable = "q IS NOT NULL AND key IS NOT NULL AND text IS NOT NULL"
    ev, tr = (materialize(df.where(usable).select("q", "key", "text").distinct().select("q", "key", words_udf("text").alias("w")).where("size(w) > 0"), name) for df, name in ((evaluation, "eval-split"), (training, "train-split")))
    near = tr.join(ev.select("key").distinct(), "key", "left_semi")
    light = frozenset(small_words(ev, near) if small is None else small)
    buckets = max(2 * slots(ev.sparkSession), -(-(ev.count() + near.count()) // rows_per_bucket))
    left, right = _dealt(ev, near, rows_per_slice, buckets)
    kind = dict(ev.dtypes)["q"]

    def verify(_key: tuple, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for df in (e, t):
            texts: dict[tuple, list] = defaultdict(list)  # texts that agree are compared once
            for q, part, w in zip(df["q"], df["part"], df["w"], strict=True):
                texts[part, tuple(w)].append(q)
            sides.append([(part, list(w), ids) for (part, w), ids in texts.items()])
        rows = []
        for i, j in meetings([s[:2] for s in sides[0]], [s[:2] for s in sides[1]], light):
            (_, x, a), (_, y, b) = sides[0][i], sides[1][j]
            if (unlike := near_same(x, y, light)) is not None:
                rows += [(p, q, [u for u, _ in unlike], [v for _, v in unlike]) for p in a for q in b]
        return pd.DataFrame(rows, columns=["a", "b", "wa", "wb"])

    verified = materialize(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(verify, f"a {kind}, b {kind}, wa array<string>, wb array<string>"), "verified")
    doubtful = verified.where(F.size("wa") > 0).select("a", "b", F.posexplode(F.arrays_zip("wa", "wb")).alias("i", "w"))
    sides = doubtful.select("a", "b", "i", F.explode(F.array("w.wa", "w.wb")).alias("word"))
    used = ev.select("key", "w").unionByName(tr.select("key", "w")).select("key", F.explode("w").alias("word"))
    known = known_words(sides.select("word").distinct(), used.distinct(), known_in, share)
    other = sides.join(known, "word", "left_semi").groupBy("a", "b", "i").agg(F.count("*").alias("n")).where("n > 1").select("a", "b").distinct()
    return verified.join(other, ["a", "b"], "left_anti").select("a", "b").distinct()
