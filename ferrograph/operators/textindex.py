"""The inverted index: tokens, postings, candidate files of a symbol, and occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.session import kept

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
CUTOFF = 1000


def tokenize(files: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Distinct ``(token, path)``; distinct already within a file, before anything is shuffled."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("token")).select("token", "path")


def postings(tokens: DataFrame) -> DataFrame:
    """The index in array form: ``(token, paths)``."""
    return tokens.groupBy("token").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def posting_heads(tokens: DataFrame) -> DataFrame:
    """``(token, files, first_path)`` of distinct postings; no list of paths is held anywhere."""
    return tokens.groupBy("token").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def posting_sizes(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count_distinct("path").alias("files"))


def line_occurrences(files: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(path, token, line, place)``: every token by line, with its number in the line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "content"))
    return lines.select("path", "line", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("place", "token"))


def tokens_of_files(files: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(path, token, lines, first_place)``: in how many lines of a file each token is, and its least number in a line.

    A file's tokens are counted in its row, so that nothing is shuffled but files whose path is there more than once.
    """
    twice = kept(files.groupBy("path").count().filter("count > 1").select(F.col("path").alias("again")), "twice")
    same = F.col("path").eqNullSafe(F.col("again"))
    lone = files.select("path", F.array("content").alias("texts"))
    if not twice.isEmpty():
        lone = lone.join(twice, same, "left_anti").unionByName(files.join(twice, same, "left_semi").groupBy("path").agg(F.collect_list("content").alias("texts")))
    by_line = lambda text: F.transform(F.split(text, "\n", -1), lambda line, k: F.struct(k.alias("line"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("tokens")))
    rows = lone.select("path", F.flatten(F.transform(F.filter("texts", lambda t: t.isNotNull()), by_line)).alias("lines"))
    return rows.mapInArrow(count_tokens, "path string, token string, lines long, first_place long")


def count_tokens(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Of batches (path, lines: list of (line, tokens)), each row being a file."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            lines = part.column("lines")
            entries = lines.flatten()
            words = entries.field("tokens").flatten()
            if not len(words):
                continue
            sizes = np.diff(entries.field("tokens").offsets.to_numpy())
            line = np.repeat(np.arange(len(entries)), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            coded = words.dictionary_encode()
            token, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            file_of_line = np.repeat(np.arange(part.num_rows), np.diff(lines.offsets.to_numpy()))
            _, first = np.unique(line * many + token, return_index=True)  # a token's first place in each line
            number, where = entries.field("line").to_numpy()[line[first]], file_of_line[line[first]] * many + token[first]
            order = np.lexsort((number, where))
            where, number, place = where[order], number[order], place[first][order]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            new_line = np.r_[True, (where[1:] != where[:-1]) | (number[1:] != number[:-1])]
            found = where[starts]
            columns = [part.column("path").take(pa.array(found // many)), coded.dictionary.take(pa.array(found % many)), pa.array(np.add.reduceat(new_line.astype(np.int64), starts)), pa.array(np.minimum.reduceat(place, starts))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "token", "lines", "first_place"])


def scout(targets: DataFrame, tokens: DataFrame, cutoff: int = CUTOFF, use_context: bool = False) -> DataFrame:
    """Candidate files of each target (fqn, name): those with its name.

    With use_context, those that also have the token before the name in its FQN, if fewer than ``cutoff`` files have that.
    Without, nothing is missed: a file may use a member and never name its owner.
    """
    wanted = targets.select("fqn", F.col("name").alias("token"), naming.scouting_context(F.col("fqn"), F.col("name")).alias("context")).distinct()
    primary = wanted.join(tokens, "token").select("fqn", "context", "path")
    if not use_context:
        return primary.select("fqn", "path").distinct()
    contexts = tokens.join(wanted.select(F.col("context").alias("token")).dropna().distinct(), "token", "left_semi")
    few = posting_sizes(contexts).filter(F.col("files") < cutoff).select(F.col("token").alias("context"))
    narrow = contexts.select(F.col("token").alias("context"), "path").join(few, "context", "left_semi").distinct()
    limited = primary.join(few, "context", "left_semi").join(narrow, ["context", "path"], "left_semi")
    others = primary.join(few, "context", "left_anti")
    return limited.select("fqn", "path").union(others.select("fqn", "path")).distinct()
