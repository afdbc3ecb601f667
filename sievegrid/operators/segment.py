"""Words of Han texts, which have no blanks: a dictionary learnt from the corpus, then the most probable split of each run.

A string of up to ``LONGEST`` characters is a word if it is frequent, holds together (it comes more often than its halves
would meet by chance) and stands free (what comes before and after it varies: the entropy of its neighbours). All three
are counts and joins by string. A run is split so that the sum of its words' costs is least; costs are whole numbers of
-log(share), so ties are exact. Strings are counted inside the tasks, stretch by stretch, and only counts move. A dictionary of up to
``MOST_SENT`` words is sent to the tasks, and texts are cut where they lie, many runs at once; with a larger one distinct runs are
split once, their substrings meeting it in a join.

Defined results: null and empty texts have no words; a character that the dictionary doesn't hold is a word by itself and
costs as much as half an occurrence; of equally good splits the one with the longer first word counts, and so on; repeated rows
count as often as they come; an empty table gives an empty dictionary, with which every character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievegrid.functions.text import text_or_empty
from sievegrid.sources.folders import new_path

LONGEST = 4
LEAST_COUNT, COHESION, FREEDOM = 5, 1.0, 0.6
HAN_RUN = "[一-鿿]+"
#: Runs of Han characters, or of other letters and digits.
PIECE = r"[一-鿿]+|[\p{L}\p{N}&&[^一-鿿]]+"
COST_SCALE = 1_000_000
_DIGITS = 6
_FIRST, _LAST = 0x4E00, 0x9FFF
#: Bits of a Han character's code.
_BITS = 15
#: Characters that a task takes at a time, about.
AT_ONCE = 1 << 20
#: Words of a dictionary that is sent to the tasks; a larger one is joined.
MOST_SENT = 1 << 20
#: Of the runs of a stretch, so many of the longest are split one by one.
ALONE = 16
_NEVER = 1 << 60


def _chars(run: Column) -> Column:
    return F.filter(F.split(run, ""), lambda c: c != "")


def _substrings(chars: Column, longest: int) -> Column:
    """(start, size, word, before, after) of all substrings of a run; a neighbour beyond the run's end is an empty string.

    ``chars`` must be a column as it stands: an expression would be evaluated anew at each place.
    """
    starts = F.sequence(F.lit(0), F.size(chars) - 1)

    def at(i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(chars) - i))
        return F.transform(sizes, lambda n: F.struct(i.alias("start"), n.alias("size"), F.array_join(F.slice(chars, i + 1, n), "").alias("word"), F.coalesce(F.get(chars, i - 1), F.lit("")).alias("before"), F.coalesce(F.get(chars, i + n), F.lit("")).alias("after")))

    return F.flatten(F.transform(starts, at))


def _codes(texts: list[str]) -> np.ndarray:
    """Han characters from 1; all others and the ends of texts are 0."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= _FIRST) & (points <= _LAST), points - _FIRST + 1, 0)


def _written(chars: np.ndarray) -> pa.Array:
    """Strings of the rows of a table of codes: every Han character has three bytes."""
    points, size = chars + (_FIRST - 1), chars.shape[1]
    data = np.stack([0xE0 | points >> 12, 0x80 | points >> 6 & 63, 0x80 | points & 63], axis=-1).astype(np.uint8)
    ends = np.arange(len(chars) + 1, dtype=np.int32) * (3 * size)
    return pa.StringArray.from_buffers(len(chars), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _counted(codes: np.ndarray, starts: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings as rows of codes, counts) of each size up to ``size``, of the strings that begin before ``starts``."""
    codes = np.concatenate([codes, np.zeros(size, np.int64)])
    at = np.flatnonzero(codes[:starts])
    parent, chars = np.zeros(len(at), np.int64), np.zeros((1, 0), np.int64)
    for n in range(size):
        last = codes[at + n]
        at, parent, last = at[last > 0], parent[last > 0], last[last > 0]
        held = pa.array(parent << _BITS | last).dictionary_encode()
        own, parent = held.dictionary.to_numpy(), held.indices.to_numpy().astype(np.int64)
        chars = np.hstack([chars[own >> _BITS], (own & (1 << _BITS) - 1)[:, None]])
        yield chars, np.bincount(parent, minlength=len(own))


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``AT_ONCE`` characters."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def gram_counts(texts: DataFrame, text_col: str, size: int) -> DataFrame:
    """(word, n) of the strings of up to ``size`` characters in Han runs; a task counts a stretch of texts at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(pc.utf8_length(batch.column(0)).to_numpy()):
                codes = _codes(batch.column(0)[a:b].to_pylist())
                for start in range(0, len(codes), AT_ONCE):
                    for chars, n in _counted(codes[start : start + AT_ONCE + size - 1], AT_ONCE, size):
                        yield pa.RecordBatch.from_arrays([_written(chars), pa.array(n.astype(np.int64))], names=["word", "n"])

    found = texts.select(text_or_empty(F.col(text_col)).alias("text")).mapInArrow(each, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _neighbours(grams: DataFrame, side: str) -> DataFrame:
    """(word, sum of n log n over its neighbours on a side), from the counts of the strings that are longer by one."""
    longer = grams.where("size > 1")
    word = F.expr("substring(word, 2)" if side == "before" else "left(word, size - 1)")
    n = F.col("n").cast("double")
    return longer.groupBy(word.alias("word")).agg(F.sum(n * F.log(n)).alias(side))


def statistics(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(word, size, n, cohesion, freedom) of every substring of a Han run; single characters have no cohesion.

    A word with a neighbour is a string longer by one, so the counts of strings tell the neighbours too; what stands at a run's end is
    a neighbour of its own each time, which adds nothing to a sum of n log n. Counts are written once, as all else is made of them.
    """
    path = new_path(texts.sparkSession, "han-strings")
    gram_counts(texts, text_col, longest + 1).write.parquet(path)
    grams = texts.sparkSession.read.parquet(path).withColumn("size", F.char_length("word"))
    counts = grams.where(F.col("size") <= longest)
    total = counts.where("size = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    halves = counts.where("size > 1").select("word", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    halves = halves.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.substring("word", F.col("at") + 1, F.char_length("word")).alias("right"))
    known = counts.select("word", "n")
    halves = halves.join(known.toDF("left", "left_n"), "left").join(known.toDF("right", "right_n"), "right")
    chance = F.log(F.col("n").cast("double")) + F.log(total.cast("double")) - F.log(F.col("left_n").cast("double")) - F.log(F.col("right_n").cast("double"))
    cohesion = halves.groupBy("word").agg(F.round(F.min(chance), _DIGITS).alias("cohesion"))
    out = counts.join(cohesion, "word", "left").join(_neighbours(grams, "before"), "word", "left").join(_neighbours(grams, "after"), "word", "left")
    n = F.col("n").cast("double")
    entropy = [F.round(F.log(n) - F.coalesce(side, F.lit(0.0)) / n, _DIGITS) for side in ("before", "after")]
    return out.select("word", "size", "n", "cohesion", F.least(*entropy).alias("freedom"))


def dictionary(found: DataFrame, least: int = LEAST_COUNT, cohesion: float = COHESION, freedom: float = FREEDOM, known: DataFrame | None = None) -> DataFrame:
    """(word, cost) of all single characters and of the strings that are words; ``known`` (word, n) adds words of a given weight."""
    sure = (F.col("size") == 1) | ((F.col("n") >= least) & (F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom))
    words = found.where(sure).select("word", "n")
    if known is not None:
        words = words.join(known.select("word"), "word", "left_anti").union(known.select("word", F.col("n").cast("long")))
    total = words.agg(F.sum("n").alias("total")).scalar()
    return words.select("word", F.round(COST_SCALE * (F.log(total.cast("double")) - F.log(F.col("n").cast("double")))).cast("long").alias("cost"))


def best_split(size: int, starts: np.ndarray, sizes: np.ndarray, costs: np.ndarray, unknown: int) -> list[int]:
    """Where the words of a run of ``size`` characters begin, from (start, size, cost) of its dictionary words."""
    words: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for start, n, cost in zip(starts.tolist(), sizes.tolist(), costs.tolist()):
        words[start].append((n, cost))
    best, step = [0] * (size + 1), [1] * size
    for at in range(size - 1, -1, -1):
        options = words[at] if any(n == 1 for n, _ in words[at]) else [*words[at], (1, unknown)]
        best[at], less = min((cost + best[at + n], -n) for n, cost in options)
        step[at] = -less
    cuts, at = [], 0
    while at < size:
        cuts.append(at)
        at += step[at]
    return cuts


class Splitter:
    """The dictionary as a table for each size: numbered prefixes, found by the number of the prefix shorter by one and the last character."""

    def __init__(self, words: pa.Table, longest: int):
        costs = words["cost"].to_numpy().astype(np.int64)
        self.unknown = int(costs.max(initial=0)) + int(COST_SCALE * np.log(2))
        text = words["word"].combine_chunks()
        sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        codes = _codes(text.to_pylist())
        first = np.cumsum(sizes + 1) - sizes - 1
        han = np.add.reduceat(codes > 0, first) == sizes if len(sizes) else sizes > 0
        sound = han & (sizes > 0) & (sizes <= longest)
        first, sizes, costs = first[sound], sizes[sound], costs[sound]
        parent, self.levels = np.zeros(len(first), np.int64), []
        for n in range(longest):
            more = sizes > n
            first, sizes, costs, parent = first[more], sizes[more], costs[more], parent[more]
            keys, parent = np.unique(parent << _BITS | codes[first + n], return_inverse=True)
            cost = np.full(len(keys), _NEVER)
            np.minimum.at(cost, parent[sizes == n + 1], costs[sizes == n + 1])
            self.levels.append((keys, cost))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """The cost of the word of each size (row) at each place (column)."""
        longest = len(self.levels)
        out = np.full((longest, len(codes) + longest), _NEVER)
        codes = np.concatenate([codes, np.zeros(longest, np.int64)])
        at = np.flatnonzero(codes)
        out[0, at] = self.unknown
        parent = np.zeros(len(at), np.int64)
        for n, (keys, cost) in enumerate(self.levels):
            if not len(keys):
                break
            wanted = parent << _BITS | codes[at + n]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[place] == wanted
            at, parent = at[found], place[found]
            own = cost[parent]
            out[n, at[own < _NEVER]] = own[own < _NEVER]
        return out

    def split(self, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of runs of Han characters, one after the other, and how many each run has.

        All runs are gone through at once from their ends, a place of each at a time, but for the ``ALONE`` longest.
        """
        ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1] if len(runs) else np.zeros(1, np.int32)
        data = np.frombuffer(runs.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(runs) else np.zeros(0, np.uint8)
        sizes = np.diff(ends).astype(np.int64) // 3
        three = data.reshape(-1, 3).astype(np.int64)
        points = (three[:, 0] & 15) << 12 | (three[:, 1] & 63) << 6 | three[:, 2] & 63
        run = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.zeros(len(points) + len(sizes), np.int64)  # each run ends with a place that no word holds
        own = np.arange(len(points)) + run
        codes[own] = points - _FIRST + 1
        costs = self.costs(codes)
        first = np.cumsum(sizes + 1) - sizes - 1
        begins = np.zeros(len(codes), bool)
        order = np.argsort(-sizes, kind="stable")
        for r in order[:ALONE]:
            part = costs[:, first[r] : first[r] + sizes[r]]
            n, start = np.nonzero(part < _NEVER)
            begins[first[r] + np.array(best_split(int(sizes[r]), start, n + 1, part[n, start], self.unknown), np.int64)] = True
        self._together(first[order[ALONE:]], sizes[order[ALONE:]], costs, begins)
        marks = begins[own]
        bounds = np.append(np.flatnonzero(marks), len(points)).astype(np.int32) * 3
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        return words, np.bincount(run[marks], minlength=len(sizes))

    def _together(self, first: np.ndarray, sizes: np.ndarray, costs: np.ndarray, begins: np.ndarray) -> None:
        """As ``best_split`` for runs in falling order of size."""
        best, step = np.zeros(costs.shape[1], np.int64), np.ones(costs.shape[1], np.int64)
        ends, longer = first + sizes, len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes.max(initial=0) + 1))
        for back, many in enumerate(longer.tolist(), 1):
            at = ends[:many] - back
            least, n = costs[0, at] + best[at + 1], np.ones(many, np.int64)
            for size in range(2, len(costs) + 1):
                other = costs[size - 1, at] + best[at + size]
                n[other <= least] = size
                least = np.minimum(least, other)
            best[at], step[at] = least, n
        at = first
        while len(at):
            begins[at] = True
            at = at + step[at]
            at, ends = at[at < ends], ends[at < ends]


def sent(words: DataFrame, longest: int = LONGEST) -> Broadcast | None:
    """The dictionary for all tasks, if it has up to ``MOST_SENT`` words."""
    held = words.where("word IS NOT NULL").select("word", "cost").limit(MOST_SENT + 1).toArrow()
    return words.sparkSession.sparkContext.broadcast(Splitter(held, longest)) if held.num_rows <= MOST_SENT else None


def split_runs(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, words): the most probable words of each run of Han characters; ``runs`` (run) may hold repeats."""
    splitter = sent(words, longest)
    if splitter is None:
        return split_by_join(runs, words, longest)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(pc.utf8_length(batch.column(0)).to_numpy()):
                found, n = splitter.value.split(batch.column(0)[a:b].cast(pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), found)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["run", "words"])

    return runs.select("run").distinct().mapInArrow(each, "run string, words array<string>")


def split_by_join(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """As ``split_runs`` with a dictionary of any size: the substrings of distinct runs meet it in a join."""
    runs = runs.select("run").distinct().withColumn("key", F.unhex(F.sha2(F.col("run").cast("binary"), 256)))
    places = runs.select("key", _chars(F.col("run")).alias("chars"))
    places = places.select("key", F.explode(_substrings(F.col("chars"), longest)).alias("s")).select("key", "s.start", "s.size", "s.word")
    listed = places.join(words, "word").groupBy("key").agg(F.collect_list(F.struct("start", "size", "cost")).alias("words"))  # of one run
    unknown = words.agg(F.coalesce(F.max("cost"), F.lit(0)) + F.lit(int(COST_SCALE * np.log(2)))).scalar()
    rows = runs.join(listed, "key", "left").select("run", "words", unknown.alias("unknown"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, cuts = batch.column(0).to_pylist(), []
            for i, run in enumerate(runs):
                own = batch.column(1)[i].values
                fields = [np.zeros(0, np.int64)] * 3 if own is None else [own.field(f).to_numpy(zero_copy_only=False) for f in range(3)]
                at = best_split(len(run), *fields, batch.column(2)[i].as_py())
                cuts.append([run[a:b] for a, b in zip(at, [*at[1:], len(run)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.string()))], names=["run", "words"])

    return rows.mapInArrow(each, "run string, words array<string>")


def _pieces(text_col: str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(F.col(text_col))), F.lit(PIECE), F.lit(0))


def _cut(texts: DataFrame, splitter: Broadcast, id_col: str, text_col: str, as_lists: bool) -> DataFrame:
    """Each text's terms in their order, cut where the text lies: a row for each, or a list for each text."""
    rows = texts.select(F.col(id_col).alias("id"), _pieces(text_col).alias("pieces"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat, sizes = lists.flatten().cast(pa.string()), pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = np.append(np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) else np.zeros(0, np.uint8), np.zeros(2, np.uint8)).astype(np.int64)
        x, y, z = (data[ends[:-1] + i] for i in range(3))
        point = (x & 15) << 12 | (y & 63) << 6 | z & 63
        han = (x >= 0xE0) & (x < 0xF0) & (point >= _FIRST) & (point <= _LAST)  # a piece is Han throughout, or nowhere
        words, many = splitter.value.split(flat.filter(pa.array(han)))
        n = np.ones(len(flat), np.int64)
        n[han] = many
        piece = np.repeat(np.arange(len(flat)), n)
        order = np.empty(len(piece), np.int64)
        order[han[piece]], order[~han[piece]] = np.arange(len(words)), len(words) + np.arange(len(piece) - len(words))
        terms = pa.concat_arrays([words, flat.filter(pa.array(~han))]).take(pa.array(order))
        row, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        if as_lists:
            ends = np.append(0, np.cumsum(np.bincount(row[piece], minlength=len(sizes))))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], names=["id", "terms"])
        pos = np.arange(len(flat)) - begin[row]
        sub = np.arange(len(piece)) - (np.cumsum(n) - n)[piece]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[piece])), pa.array(pos[piece].astype(np.int32)), pa.array(sub.astype(np.int32)), terms], names=["id", "pos", "sub", "term"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            chars = np.append(0, np.cumsum(pc.utf8_length(lists.flatten()).to_numpy()))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
            for a, b in _groups(np.diff(chars)):
                yield cut(batch.slice(a, b - a))

    kinds = "terms array<string>" if as_lists else "pos int, sub int, term string"
    return rows.mapInArrow(each, StructType([rows.schema["id"], *StructType.fromDDL(kinds)]))


def tokens(texts: DataFrame, words: DataFrame, id_col: str = "child_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, pos, sub, term): words of Han runs and, in lower case, runs of other letters and digits, in the order of (pos, sub)."""
    splitter = sent(words, longest)
    if splitter is not None:
        return _cut(texts, splitter, id_col, text_col, False)
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(_pieces(text_col)).alias("pos", "run"))
    han = F.col("run").rlike(f"^{HAN_RUN}")
    split = split_by_join(rows.where(han).select("run"), words, longest)
    cut = rows.where(han).join(split, "run").select("id", "pos", F.posexplode("words").alias("sub", "term"))
    return cut.unionByName(rows.where(~han).select("id", "pos", F.lit(0).alias("sub"), F.col("run").alias("term")))


def term_lists(texts: DataFrame, words: DataFrame, id_col: str = "child_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, terms): a row for each text, its ``tokens`` in their order; ids are unique."""
    splitter = sent(words, longest)
    if splitter is not None:
        return _cut(texts, splitter, id_col, text_col, True)
    listed = tokens(texts, words, id_col, text_col, longest).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "term"))).alias("t"))
    terms = F.coalesce(F.transform("t", lambda x: x["term"]), F.array().cast("array<string>"))
    return texts.select(F.col(id_col).alias("id")).join(listed, "id", "left").select("id", terms.alias("terms"))
