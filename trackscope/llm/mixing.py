"""Mixtures of sources by target shares of tokens (problem 7).

Method: Efraimidis-Spirakis sampling. Every document gets an exponential key scaled by its quality weight; within each
source the documents are taken by growing key until the source's token budget is reached. A budget beyond the source's
size is served by complete epochs first, and the fractional rest is selected by key. The order within a source is never
built in one task: keys fall into ``BUCKETS`` ranges, token sums of ranges are prefix-summed, and only the range in
which the budget ends is sorted.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..session import cut_lineage

#: Vocabulary file of a public tokenizer: ``.tiktoken``, tokenizers' ``.json`` or sentencepiece's ``.model``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's text is cut before pairs are merged (a fixed value that belongs to the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BUCKETS = 1 << 16
_KEY_PARTS = 1 << 52


@lru_cache(maxsize=4)
def token_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text; special tokens' strings are ordinary text."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def quality(text: str) -> float:
    """A weight in (0, 1]: the share of letters and blanks, less for texts that repeat their words and lines."""
    words = text.split()
    if not words:
        return 0.01
    plain = sum(c.isalpha() or c.isspace() for c in text) / len(text)
    lines = [line for line in re.split(r"[\r\n]+", text) if line.strip()]
    return max(0.01, plain * (len(set(words)) / len(words)) ** 0.5 * len(set(lines)) / max(len(lines), 1))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, source, tokens, quality) of whole texts; null and empty texts have no tokens. Sources are in one spelling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([counter(t) if t else 0 for t in texts], pa.int64()), pa.array([quality(t) for t in texts], pa.float64())], names=[doc, "source", "tokens", "quality"])

    return documents.select(doc, names.slug(F.col("source")).alias("source"), text).mapInArrow(count, f"`{doc}` {documents.schema[doc].dataType.simpleString()}, source string, tokens long, quality double")


def sampling_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from the hash of the record, so that a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(identity, F.lit(seed)), F.lit(_KEY_PARTS)) + 0.5) / float(_KEY_PARTS)
    return -F.log(u) / weight


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens for each source: its share of ``total``, at most ``max_repeats`` times its size.

    What capped sources leave is shared out among the others by their shares, until none is over its cap, so that the
    total is reached wherever the caps allow it. Sources without documents get nothing.
    """
    caps = {s: float(sizes.get(s, 0)) * max(repeats, 0) for s, (_, repeats) in targets.items()}
    given = dict.fromkeys(targets, 0.0)
    free = {s for s, (share, _) in targets.items() if share > 0 and caps[s] > 0}
    left = float(total) if sum(share for share, _ in targets.values()) > 0 else 0.0
    while free:
        weight = sum(targets[s][0] for s in free)
        full = {s for s in free if targets[s][0] / weight * left >= caps[s]}
        if not full:
            return given | {s: targets[s][0] / weight * left for s in free}
        for s in full:
            given[s] = caps[s]
            left -= caps[s]
        free -= full
    return given


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most repeats), a fixed table of a few rows; of repeated sources the shares add up and the smallest cap holds."""
    rows = targets.select(names.slug(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND source <> '' AND target_share > 0")
    grouped = rows.groupBy("source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats")).collect()
    return {r["source"]: (r["share"], r["repeats"]) for r in grouped}


def mix(sized: DataFrame, targets: dict[str, tuple[float, int]], doc: str = "doc_id", seed: int = 0) -> DataFrame:
    """(doc, source, tokens, repeats): how often each chosen document is used.

    ``sized``: (doc, source, tokens, quality), read several times, so stored. The total is that of all documents, those
    of sources without a target included. A document without tokens is never used. The document at which a budget ends
    is used if at least half of it fits; ties of keys are taken by id.
    """
    spark = sized.sparkSession
    sums = {r["source"]: r["tokens"] for r in sized.where(F.col("source").isin(list(targets)) if targets else F.lit(False)).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = [(s, *divmod(tokens, sums[s])) for s, tokens in budgets(sums, targets, total).items() if sums.get(s, 0) > 0]
    wanted = spark.createDataFrame([(s, int(epochs), float(rest)) for s, epochs, rest in plan], "source string, epochs int, rest double")

    key = sampling_key(F.col(doc), F.col("quality"), seed).alias("key")
    keyed = sized.where("tokens > 0").select(doc, "source", "tokens", key).join(F.broadcast(wanted), "source")  # as many rows as targets
    ranged = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    heaps = ranged.groupBy("source", "bucket").agg(F.sum("tokens").alias("heap"), F.max("rest").alias("_rest")).withColumn("before", F.sum("heap").over(by_bucket) - F.col("heap"))
    last = heaps.where("before < _rest AND before + heap >= _rest").select("source", F.col("bucket").alias("last"), "before")
    placed = ranged.join(F.broadcast(last), "source", "left")  # one row for each source at most
    inside = placed.where("bucket = last").withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", doc).rowsBetween(Window.unboundedPreceding, 0)))
    edge = inside.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = placed.where("last IS NULL OR bucket <> last").withColumn("extra", F.coalesce((F.col("bucket") < F.col("last")).cast("int"), F.lit(0)))
    chosen = others.select(doc, "source", "tokens", "epochs", "extra").unionByName(edge.select(doc, "source", "tokens", "epochs", "extra"))
    return chosen.select(doc, "source", "tokens", (F.col("epochs") + F.col("extra")).alias("repeats")).where("repeats > 0")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """``mix`` of documents by the table (source, target_share, max_repeats)."""
    return mix(cut_lineage(token_sizes(documents, tokenizer)), read_targets(targets), seed=seed)


def mixture_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """Per source with a target: its size, cap, target and actual tokens and shares, documents used and most repeats."""
    sized = cut_lineage(token_sizes(documents, tokenizer))
    wanted = read_targets(targets)
    rows = documents.sparkSession.createDataFrame([(s, share, int(cap)) for s, (share, cap) in wanted.items()], "source string, target_share double, max_repeats int")
    used = mix(sized, wanted, seed=seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = sized.agg(F.sum("tokens").alias("_total"))
    return rows.join(used, "source", "left").join(held, "source", "left").crossJoin(total).select(
        "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.expr("try_divide(tokens, _total)"), F.lit(0.0)).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
