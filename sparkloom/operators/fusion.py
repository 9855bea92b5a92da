"""Seven ways to find a source for a query, each a ranking of its own, and their reciprocal-rank fusion.

Sources' surfaces become rows of tokens that meet the queries' terms by an equi-join, so no query is compared with a source it shares nothing with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from ..functions.text import tokenize
from ..sources.scratch import written
from . import ranking, ranks

# Fixed value: the words that a question begins with.
QUESTION = r"(?i)^(how|what|why|when|where|which|can|does|do|is|are)\b"
PATHS = ("lexical_chunk", "path_filename", "title_h1", "heading", "alias", "anchor", "question_heading")
#: Pairs of sources and queries in a block; scores are whole numbers of STEP, fused ones of FUSED.
CELLS, STEP, FUSED = 250_000, 1e6, 1e9
#: What is ranked together is cut by score: into bands of 2 ** WIDE steps, fused scores into bands of 2 ** NARROW, LAST of them at most.
WIDE, NARROW, LAST = 16, 7, 255


def surfaces(profiles: DataFrame) -> DataFrame:
    """(source, path, part, token): distinct tokens of each surface. profiles: source, title, h1, headings, aliases (structs kind, value), questions.

    An alias and a question is a part by itself; the other surfaces have one part. Null surfaces have no tokens.
    """
    one = lambda path, text: F.array(F.struct(F.lit(path).alias("path"), F.lit("").alias("part"), text.alias("text")))
    none = F.array().cast("array<string>")
    each = lambda path, values: F.transform(F.array_distinct(F.coalesce(values, none)), lambda v: F.struct(F.lit(path).alias("path"), F.coalesce(v, F.lit("")).alias("part"), v.alias("text")))
    parts = F.concat(
        one("path_filename", F.col("source")), one("title_h1", F.concat_ws(" ", "title", "h1")), one("heading", F.concat_ws(" . ", "headings")),
        each("alias", F.transform("aliases", lambda a: a["value"])), each("question_heading", F.col("questions")),
    )
    texts = profiles.select("source", F.explode(parts).alias("f")).select("source", "f.*")
    return texts.select("source", "path", "part", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))


def surface_hits(rows: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """(query, source, path, score). terms: (query, term, question), distinct terms and whether the query is a question.

    The score is the number of matched tokens; of aliases the number of hit ones; of questions the best overlap, of two tokens at least. Nothing is shuffled if rows are dealt by source and the terms are BROADCAST_TERMS at most.
    """
    small = terms.count() <= ranking.BROADCAST_TERMS
    if not small:
        rows = rows.join(terms.select("term").distinct(), F.col("token") == F.col("term"), "left_semi")
    hits = rows.join(F.broadcast(terms) if small else terms, (F.col("token") == F.col("term")) & (F.col("question") | (F.col("path") != "question_heading")))
    parts = hits.groupBy(query, "source", "path", "part").agg(F.count(F.lit(1)).alias("n")).where("path <> 'question_heading' OR n >= 2")
    score = F.when(F.col("path") == "alias", F.count(F.lit(1))).otherwise(F.max("n"))
    return parts.groupBy(query, "source", "path").agg(score.alias("score"))


def anchor_hits(profiles: DataFrame, anchors: DataFrame, query: str) -> DataFrame:
    """(query, source, score): sources whose path ends with an anchored file, or that have an anchored symbol or route. anchors: (query, kind, value)."""
    parts = F.split("source", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    files = profiles.select("source", F.explode(tails).alias("key")).withColumn("k", F.lit("file"))
    named = F.filter("aliases", lambda a: a["kind"].isin("symbol", "route"))
    symbols = profiles.select("source", F.explode(F.array_distinct(F.transform(named, lambda a: F.lower(a["value"])))).alias("key")).withColumn("k", F.lit("symbol"))
    asked = anchors.where(F.col("kind").isin("file", "symbol")).select(query, "kind", F.when(F.col("kind") == "symbol", F.lower("value")).otherwise(F.col("value")).alias("asked"))
    found = files.unionByName(symbols)
    asked = F.broadcast(asked) if asked.count() <= ranking.BROADCAST_TERMS else asked
    return found.join(asked, (F.col("key") == F.col("asked")) & (F.col("k") == F.col("kind"))).groupBy(query, "source").agg(F.count(F.lit(1)).alias("score"))


def _ranked(hits: DataFrame, query: str, *order: Column) -> DataFrame:
    return hits.select(query, "source", "path", F.row_number().over(Window.partitionBy(query, "path").orderBy(*order)).alias("rank"), F.col("score").cast("double").alias("score"))


def candidates(profiles: DataFrame, terms: DataFrame, anchors: DataFrame, lexical: DataFrame, query: str) -> DataFrame:
    """(query, source, path, rank, score) of all seven paths. lexical: (query, source, rank, score) of chunks."""
    found = _ranked(surface_hits(surfaces(profiles), terms, query), query, F.desc("score"), F.col("source"))
    anchored = _ranked(anchor_hits(profiles, anchors, query).withColumn("path", F.lit("anchor")), query, F.col("source"))
    best = lexical.groupBy(query, "source").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("first")).withColumn("path", F.lit("lexical_chunk"))
    return found.unionByName(anchored).unionByName(_ranked(best, query, F.col("first"), F.col("source")))


def fused(paths: DataFrame, query: str) -> DataFrame:
    """(query, source, fused, n_paths, rank): sources by fused score, ties by name."""
    out = ranking.fuse(paths, query, "source").withColumn("fused", F.round("fused", 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("fused"), "source")))


def _whole(x: np.ndarray) -> np.ndarray:
    """x to the nearest whole number as SQL rounds doubles, halves up."""
    low = np.floor(x)
    return (low + (x - low >= 0.5)).astype(np.int64)


def _lists(block: int, group: np.ndarray, band: np.ndarray, key: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, pa.Table]:
    """The order of the cells by group and band, and a table with a list of keys for each of these. tie: of the first cells in that order."""
    by = group << 20 | band
    order = np.argsort(by, kind="stable")
    starts = np.flatnonzero(np.diff(by[order], prepend=-1))
    offsets = np.append(starts, len(order))
    cut = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
    first = order[starts]
    tied = tie[order[: len(tie)]]
    columns = {"block": pa.array(np.full(len(starts), block)), "g": pa.array(group[first]), "band": pa.array(band[first].astype(np.int32)), "key": cut(key[order].astype(np.int32), offsets), "tie": cut(tied, np.minimum(offsets, len(tie)))}
    return order, pa.table(columns)


_LISTS = "block bigint, g bigint, band int, key array<int>, tie array<bigint>"


def _merged(lists: pa.Table) -> pa.Table:
    """Places in one group and band by falling key, then tie; without ties, by block and place in its list."""
    lists = lists.sort_by("block")
    keys, ties = lists["key"].combine_chunks(), lists["tie"].combine_chunks().flatten().to_numpy()
    key = keys.flatten().to_numpy()
    order = np.lexsort((ties, -key)) if len(ties) else np.argsort(-key, kind="stable")
    place = np.empty(len(key), np.int32)
    place[order] = np.arange(1, len(key) + 1, dtype=np.int32)
    offsets = np.append(0, np.cumsum(keys.value_lengths().to_numpy()))
    return pa.table({"block": lists["block"], "g": lists["g"], "band": lists["band"], "place": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place))})


def _places(lists: DataFrame) -> DataFrame:
    """(block, g, band, place, start): the place of each key of a list in its group and band, and how many of its group are in higher bands. Only keys and places travel, as lists."""
    merged = written(lists.groupBy("g", "band").applyInArrow(_merged, "block bigint, g bigint, band int, place array<int>"), "places")
    above = Window.partitionBy("g").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("g", "band").agg(F.sum(F.size("place")).alias("n")).select("g", "band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"))
    return merged.join(F.broadcast(starts), ["g", "band"]).select("block", "g", "band", "place", "start")


def _rank(placed: pa.Table) -> np.ndarray:
    """The ranks of a block's cells in the order of their groups and bands."""
    placed = placed.sort_by([("g", "ascending"), ("band", "ascending")])
    places = placed["place"].combine_chunks()
    return np.repeat(placed["start"].to_numpy(), places.value_lengths().to_numpy()) + places.flatten().to_numpy()


class InPlace:
    """Candidates of all seven paths where one source is one document: each block of sources finds its own scores and learns their ranks, so that no pair of a source and a query is shuffled or written with more than its score and its ranks.

    profiles: source (unique) and what surfaces takes; terms, anchors: as in candidates; found: the scorer of the documents, each a row with a key (a whole number, unique) and the source carried; factor: times bm25, the score of a document; queries: all of them.
    Documents of one score are ranked by key, sources of one score of another path, or of one fused score, by source.
    """

    def __init__(self, profiles: DataFrame, terms: DataFrame, anchors: DataFrame, found: ranking.Scorer, key: str, factor: float, queries: list, query: T.StructField):
        self.query, self.queries, self.found, self.factor, self.key = query, queries, found, factor, key
        numbers = F.broadcast(profiles.sparkSession.createDataFrame([(v, i) for i, v in enumerate(queries)], T.StructType([query, T.StructField("__q", T.LongType())])))
        numbered = lambda df: df.join(numbers, query.name).drop(query.name)
        dealt = profiles.repartition("source")
        code = F.array_position(F.array(*[F.lit(p) for p in PATHS]), F.col("path")) - 1
        listed = lambda hits, name: hits.groupBy("source").agg(F.collect_list(F.struct((code * len(queries) + F.col("__q")).alias("g"), F.col("score").cast("int").alias("key"))).alias(name))
        shown = listed(surface_hits(surfaces(dealt), numbered(terms), "__q"), "shown")
        anchored = listed(anchor_hits(dealt, numbered(anchors), "__q").withColumn("path", F.lit("anchor")), "anchored")
        names = ranks.ranked(found.rows.select("source"), [], [F.asc("source")], "pos")
        none = lambda c: F.coalesce(c, F.array().cast("array<struct<g:bigint,key:int>>"))
        docs = found.rows.join(names, "source").join(shown, "source", "left").join(anchored, "source", "left")
        block = F.floor(F.col("pos") / max(64, CELLS // max(len(queries), 1))).alias("block")
        self.docs = written(docs.select(block, "pos", "source", key, "len", "code", "f", "title_f", "runs", F.concat(none(F.col("shown")), none(F.col("anchored"))).alias("hits")), "blocks")
        self.places = _places(self.docs.groupBy("block").applyInArrow(self._up(), _LISTS))

    def _cells(self) -> Callable[[pa.Table], tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
        """Gives a block's sources, in order, its cells' sources by place, groups (path, query) and keys, and the lists of these."""
        key, scores, best, width, factor = self.key, self.found.scores, self.found.best, len(self.queries), self.factor
        number = {q: i for i, q in enumerate(self.queries)}
        at = np.array([number[q] for q in self.found.queries], np.int64)

        def cells(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
            table = table.sort_by("pos").combine_chunks()
            doc, group, keys = [], [], []
            begin = 0
            for batch in table.to_batches():
                for d, q, _, _, _, boosted in scores(batch):
                    doc.append(begin + d)
                    group.append(at[q])
                    keys.append(_whole(factor * (boosted / best[q]) * STEP))
                begin += batch.num_rows
            n = sum(map(len, doc))
            hits = table["hits"].combine_chunks()
            doc = np.concatenate([*doc, np.repeat(np.arange(table.num_rows), hits.value_lengths().to_numpy())])
            flat = hits.flatten()
            group, keys = np.concatenate([*group, flat.field("g").to_numpy()]), np.concatenate([*keys, flat.field("key").to_numpy()])
            tie = table[key].to_numpy().astype(np.int64)[doc[:n]]
            by = np.where(group // max(width, 1) == PATHS.index("anchor"), 0, keys)  # anchored sources go by name alone
            order, lists = _lists(table["block"][0].as_py(), group, by >> WIDE, by, tie)
            return table, doc[order], group[order], keys[order], lists

        return cells

    def _up(self) -> Callable[[pa.Table], pa.Table]:
        cells = self._cells()
        return lambda table: cells(table)[-1]

    def candidates(self) -> DataFrame:
        """(query, source, path, rank, score)."""
        cells, width, name = self._cells(), len(self.queries), self.query.name
        names, paths = pa.array(self.queries, pa_type(self.query.dataType)), pa.array(PATHS)

        def give(docs: pa.Table, placed: pa.Table) -> pa.Table:
            docs, doc, group, key, _ = cells(docs)
            score = np.where(group < width, key / STEP, key)
            return pa.table({name: names.take(pa.array(group % width)), "source": docs["source"].combine_chunks().take(pa.array(doc)), "path": paths.take(pa.array(group // width)), "rank": pa.array(_rank(placed).astype(np.int64)), "score": pa.array(score)})

        schema = T.StructType([self.query, T.StructField("source", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("score", T.DoubleType())])
        return self.docs.groupBy("block").cogroup(self.places.groupBy("block")).applyInArrow(give, schema)

    def fused(self) -> DataFrame:
        """(query, source, fused, n_paths, rank)."""
        cells, width, name = self._cells(), len(self.queries), self.query.name
        names, groups = pa.array(self.queries, pa_type(self.query.dataType)), len(PATHS) * len(self.queries)

        def fuse(docs: pa.Table, placed: pa.Table):
            """The block's sources, and of each pair its source by place, query, fused score and number of paths, in the order of the lists of fused scores."""
            docs, doc, group, _, _ = cells(docs)
            placed = placed.filter(pc.less(placed["g"], groups))
            cell = doc * width + group % width
            # Summed in the order of the paths.
            by = np.lexsort((group, cell))
            starts = np.flatnonzero(np.diff(cell[by], prepend=-1))
            n = np.diff(np.append(starts, len(by)))
            shares = (1.0 / (ranking.RRF_K + _rank(placed)))[by]
            total = np.zeros(len(starts))
            for k in range(int(n.max(initial=0))):
                has = n > k
                total[has] += shares[starts[has] + k]
            pair, key = cell[by][starts], _whole(total * FUSED)
            order, lists = _lists(docs["block"][0].as_py(), groups + pair % width, np.minimum(key >> NARROW, LAST), key, np.empty(0, np.int64))
            return docs, (pair // width)[order], (pair % width)[order], key[order], n[order], lists

        def give(docs: pa.Table, placed: pa.Table) -> pa.Table:
            docs, doc, q, key, n, _ = fuse(docs, placed)
            rank = _rank(placed.filter(pc.greater_equal(placed["g"], groups)))
            return pa.table({name: names.take(pa.array(q)), "source": docs["source"].combine_chunks().take(pa.array(doc)), "fused": pa.array(key / FUSED), "n_paths": pa.array(n.astype(np.int64)), "rank": pa.array(rank.astype(np.int64))})

        schema = T.StructType([self.query, T.StructField("source", T.StringType()), T.StructField("fused", T.DoubleType()), T.StructField("n_paths", T.LongType()), T.StructField("rank", T.LongType())])
        together = lambda placed, f, schema: self.docs.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(f, schema)
        last = _places(together(self.places, lambda docs, placed: fuse(docs, placed)[-1], _LISTS))
        return together(self.places.unionByName(last), give, schema)
