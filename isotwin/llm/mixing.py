"""Mixing sources to target shares of tokens.

Method: cube-method balanced sampling. A source's pages are to be repeated ``r`` times on average: each is taken ``floor(r)``
times for certain and once more with the remaining probability. These fractional probabilities move through the null-space of
the constraints (numbers of pages and of tokens) until each is 0 or 1, block by block and then over what the blocks leave, so
that only a small landing problem remains per source.
"""

from __future__ import annotations

import ast
import base64
import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotwin.session import cut

#: Folder of the public tokenizers' vocabularies, and the one that tokens are counted with.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pages in a block of the flight phase, about.
BLOCK = 2000

_encodings: dict[int, object] = {}


def _vocabulary(folder: str, vocabulary: str) -> tuple[int, str, bytes]:
    """A vocabulary of ranks and the pattern that goes with it, read once on the driver: a number that tells it from others, pattern, file.

    The folder describes its files in ``__init__.py``; the pattern is the text there called ``PATTERN``, which is read, not run.
    """
    names = ast.parse((Path(folder) / "__init__.py").read_text())
    pattern = next(ast.literal_eval(n.value) for n in names.body if isinstance(n, ast.Assign) and n.targets[0].id == "PATTERN")
    ranks = (Path(folder) / vocabulary).read_bytes()
    return zlib.crc32(ranks + pattern.encode()), pattern, ranks


def _encoding(key: int, pattern: str, ranks: bytes):
    """The byte-level tokenizer of a vocabulary; built once per Python worker."""
    if key not in _encodings:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def count_tokens(pages: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of every page with a text; whole texts are encoded, an empty one has 0 tokens.

    The vocabulary file is read on the driver and broadcast: it is as large as the vocabulary, under a megabyte here.
    """
    sent = pages.sparkSession.sparkContext.broadcast(_vocabulary(folder, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(*sent.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    slim = pages.where("text is not null").select("doc_id", "source", "text")
    return slim.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase of the cube method: probabilities after which at most two are not 0 or 1.

    Three open units at a time move along the direction that keeps their sum and their token total, either way with the
    chance that keeps each expectation, until one of them is 0 or 1.
    """
    p = p.astype(float).copy()
    waiting = [int(k) for k in rng.permutation(len(p)) if 1e-9 < p[k] < 1 - 1e-9][::-1]
    draws = rng.random(len(waiting) + 3)
    held: list[int] = []
    for draw in draws:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u = (float(tokens[b] - tokens[c]), float(tokens[c] - tokens[a]), float(tokens[a] - tokens[b]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u) if x)
        step = up if draw < down / (up + down) else -down
        for k, x in zip(held, u):
            p[k] += step * x
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(p: list[float], tokens: list[int]) -> list[int]:
    """The 0 or 1 of each open unit whose page and token totals come nearest to the expected ones; for few units."""
    n = len(p)
    want_n, want_t = sum(p), sum(x * t for x, t in zip(p, tokens))
    scale = max(1.0, max(tokens, default=1))
    cost = lambda bits: abs(sum(bits) - want_n) + abs(sum(t for b, t in zip(bits, tokens) if b) - want_t) / scale
    return list(min((tuple(k >> i & 1 for i in range(n)) for k in range(1 << n)), key=cost)) if n else []


def mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """The chosen pages: ``doc_id, source, tokens, repeats``, each page once, ``repeats`` from 1 to the source's cap.

    ``counted``: ``doc_id, source, tokens`` (``count_tokens``). ``targets``: ``source, target_share, max_repeats``, small by
    nature and read by the driver; of rows that name a source twice the shares add up and the smaller cap holds. The mix has
    ``total_tokens`` tokens, or as many as the caps allow with all shares exact. Sources that are absent from either table, or
    have no tokens, share or cap, are left out and the other shares taken relative to their sum; a null source is no source.
    Where a given total asks more of a source than its cap allows, the source gives all it may. Ties cannot occur: equal pages
    are chosen by chance, the same for the same ``seed``. Empty tables give no rows. Pages stored twice under two ids are two pages.

    Scale: ids and token counts alone are shuffled, in blocks of about ``block`` pages that a large source has many of;
    a block leaves at most two open pages, so each further round handles about a thousandth of the last.
    """
    spark = counted.sparkSession
    counted = cut(counted)
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect():
        share, cap = wanted.get(r["source"], (0.0, r["max_repeats"]))
        wanted[r["source"]] = (share + r["target_share"], min(cap, r["max_repeats"]))
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sums = {r["source"]: (r["n"], r["t"]) for r in counted.join(F.broadcast(names), "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    able = {s: w for s, w in wanted.items() if sums.get(s, (0, 0))[1]}
    schema = "doc_id bigint, source string, tokens bigint, repeats bigint"
    if not able:
        return spark.createDataFrame([], schema)
    share_sum = sum(w[0] for w in able.values())
    shares = {s: w[0] / share_sum for s, w in able.items()}
    most = min(sums[s][1] * cap / shares[s] for s, (_, cap) in able.items())
    total = most if total_tokens is None else total_tokens
    rate = {s: min(float(cap), shares[s] * total / sums[s][1]) for s, (_, cap) in able.items()}
    plan = spark.createDataFrame([(s, math.floor(r + 1e-9), max(0.0, r - math.floor(r + 1e-9)), max(1, math.ceil(sums[s][0] / block))) for s, r in rate.items()], "source string, base bigint, p double, blocks bigint")
    pages = counted.join(F.broadcast(plan), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, len(pdf), int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF])
        return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng))

    kept = "doc_id bigint, source string, tokens bigint, base bigint, p double, blocks bigint, block bigint"
    whole = [c.split()[0] for c in kept.split(", ")]
    flown = cut(pages.select(*whole).groupBy("source", "block").applyInPandas(fly, kept))
    settled, blocks = [flown.where("p <= 0 or p >= 1")], max(1, math.ceil(max(n for n, _ in sums.values()) / block))
    rest = flown.where("p > 0 and p < 1")
    while blocks > 1:
        blocks = math.ceil(2 * blocks / block)
        flown = cut(rest.withColumn("blocks", F.least("blocks", F.lit(blocks))).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("blocks"))).select(*whole).groupBy("source", "block").applyInPandas(fly, kept))
        settled.append(flown.where("p <= 0 or p >= 1"))
        rest = flown.where("p > 0 and p < 1")
    # At most two open pages are left per source.
    landed = []
    open_pages = rest.orderBy("source", "doc_id").collect()
    for s in {r["source"] for r in open_pages}:
        own = [r for r in open_pages if r["source"] == s]
        landed += [(r["doc_id"], s, r["tokens"], r["base"] + bit) for r, bit in zip(own, landing([r["p"] for r in own], [r["tokens"] for r in own]))]
    out = spark.createDataFrame(landed, schema)
    for part in settled:
        out = out.unionByName(part.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("bigint")).alias("repeats")))
    return out.where("repeats > 0")


def mix_shares(spark: SparkSession, chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source named in ``targets`` or chosen: its target share, and its tokens, pages, share and most repeats in the mix."""
    sums = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_pages"), F.max("repeats").alias("most_repeats"))
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    out = targets.groupBy("source").agg(F.sum("target_share").alias("target_share")).join(sums, "source", "full")
    return out.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("tokens", F.lit(0)) / total).alias("actual_share"))
