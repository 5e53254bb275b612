"""Mixing sources to target weights by balanced (cube) sampling.

Each source must give its share of the total tokens, no document more than ``max_repeat`` times. A source's
documents are wanted x = need / available times: floor(x) times each, and once more with probability
x - floor(x). The cube method moves these fractional probabilities along the null space of the balancing
equations (number of documents and tokens of the source) until they are 0 or 1, first within blocks of a
source, then for the few rows each block leaves undecided, until a landing problem of at most two rows a
source remains. So the tokens drawn match the wanted tokens up to about one document a source.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparmat.session import scratch_table

TOKENIZER = os.environ.get("SPARMAT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public byte-level BPE splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict = {}


def encoder(path: str):
    """The vocabulary of ``path`` (ranks in tiktoken's format), loaded once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


#: White space as the splitting pattern understands it (fixed value).
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SAFE_END = re.compile(r"\w(?=[ \n])")


def token_count(enc, text: str, piece: int = 200_000) -> int:
    """Tokens of ``text``, exactly as many as when it is encoded in one go; the encoder sees about ``piece`` characters at a time.

    The splitting pattern never joins a letter or digit to the white space behind it, so a text may be cut there. White
    space before a word forms a part of its own but for its last character: runs as long as ``piece`` (the pattern's
    search overflows on them) are encoded as that part directly.
    """
    if len(text) <= piece:
        return len(enc.encode_ordinary(text))
    run = re.compile(_SPACE + "{%d,}" % max(2, piece))
    total = at = 0
    while at < len(text):
        m = _SAFE_END.search(text, at + piece // 2) if len(text) - at > piece else None
        end = m.end() if m else len(text)
        part, at = text[at:end], end
        while part:
            r = run.search(part)
            if r is None:
                total += len(enc.encode_ordinary(part))
                break
            stop = r.end() if r.end() == len(part) else r.end() - 1
            total += len(enc.encode_ordinary(part[: r.start()])) + len(enc._encode_single_piece(part[r.start() : stop]))
            part = part[stop:]
    return total


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(keep, tokens): tokens of the whole text; 0 for null and empty texts.

    ``path`` names the vocabulary on every machine, or is the name of a file given to ``SparkContext.addFile``.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        for b in batches:
            n = [token_count(enc, t) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["tokens bigint"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(look, schema)


def source_key(c):
    """Source names compared without case, blanks, '-' and '_'."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_\-]+", ""))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, docs, available, wanted, times, short) per source of ``targets``.

    ``sized``: (key, tokens) per document, ``key`` as ``source_key``. wanted = target_share x tokens of all
    documents of listed sources; times = min(wanted / available, max_repeat); short: max_repeat x available
    < wanted. A source without documents has 0 available and is short when something is wanted of it.
    ``targets`` has one row a source; documents of other sources are left out.
    """
    have = sized.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("available"))
    t = targets.where("source IS NOT NULL").withColumn("key", source_key(F.col("source"))).join(have, "key", "left").fillna(0, ["docs", "available"])
    whole = t.agg(F.sum("available").alias("n")).scalar()
    wanted = F.col("target_share") * whole
    return t.select(
        "source",
        "key",
        "target_share",
        "max_repeat",
        "docs",
        "available",
        wanted.alias("wanted"),
        F.when(F.col("available") > 0, F.least(wanted / F.col("available"), F.col("max_repeat").cast("double"))).otherwise(0.0).alias("times"),
        (F.col("max_repeat") * F.col("available") < wanted).alias("short"),
    )


def flight(prob: list[float], tokens: list[int], rnd: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 keeping their sum and the sum of prob x tokens; at most two stay between."""
    p = list(prob)
    active = []
    for i in range(len(p)):
        if 0.0 < p[i] < 1.0:
            active.append(i)
        if len(active) == 3:
            a, b, c = active
            u, v, w = tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a]  # orthogonal to (1, 1, 1) and the tokens
            if not (u or v or w):
                u, v, w = 1, -1, 0
            up = down = math.inf
            for k, d in ((a, u), (b, v), (c, w)):
                if d > 0:
                    up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
                elif d < 0:
                    up, down = min(up, -p[k] / d), min(down, (p[k] - 1) / d)
            step = up if rnd.random() * (up + down) < down else -down
            for k, d in ((a, u), (b, v), (c, w)):
                x = p[k] + step * d
                p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            active = [k for k in active if 0.0 < p[k] < 1.0]
    return p


def land(prob: list[float], tokens: list[int], rnd: random.Random) -> list[float]:
    """Decide the last rows: the choice whose tokens, then whose number, come nearest to what is wanted; ties by chance."""
    best = min(
        product((0.0, 1.0), repeat=len(prob)),
        key=lambda s: (abs(sum((x - q) * t for x, q, t in zip(s, prob, tokens))), abs(sum(s) - sum(prob)), rnd.random()),
    )
    return list(best)


def sample(sized: DataFrame, planned: DataFrame, ident: str = "doc_id", block_rows: int = 5000, seed: int = 7) -> DataFrame:
    """(ident, source, tokens, repeats): how often each document is used; documents without tokens are left out.

    ``planned`` comes from ``plan`` (one row a source). A hot source is cut into blocks of about
    ``block_rows`` rows by a hash of the id: no task sees more of a source than a block. The levels for
    the undecided rows (at most two a block) follow from the largest source's number of documents.
    """
    kind = {f.name: f.dataType.simpleString() for f in sized.schema.fields}[ident]
    rates = planned.select("source", "key", "docs", "times").where("docs > 0")
    largest = rates.agg(F.max("docs")).first()[0] or 0
    rows = sized.where("tokens > 0").join(rates, "key").select(
        F.col(ident),
        "source",
        "tokens",
        F.floor("times").cast("int").alias("base"),
        (F.col("times") - F.floor("times")).alias("prob"),
        F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.ceil(F.col("docs") / block_rows)).alias("block"),
    )
    schema = f"`{ident}` {kind}, source string, tokens bigint, base int, prob double, block bigint"

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ident, kind="stable").reset_index(drop=True)
            rnd = random.Random(f"{seed}/{pdf['source'].iloc[0]}/{pdf['block'].iloc[0]}/{last}")
            order = list(range(len(pdf)))
            rnd.shuffle(order)
            tokens = pdf["tokens"].tolist()
            p = flight([pdf["prob"].iat[i] for i in order], [tokens[i] for i in order], rnd)
            if last:
                left = [j for j, x in enumerate(p) if 0.0 < x < 1.0]
                for j, x in zip(left, land([p[j] for j in left], [tokens[order[j]] for j in left], rnd)):
                    p[j] = x
            out = [0.0] * len(p)
            for j, i in enumerate(order):
                out[i] = p[j]
            return pdf.assign(prob=out)

        return run

    done = None
    blocks = math.ceil(largest / block_rows)
    while True:
        last = blocks <= 1
        moved = rows.groupBy("source", "block").applyInPandas(fly(last), schema)
        if last:
            done = moved if done is None else done.unionByName(moved)
            break
        moved = scratch_table(moved, "cube")
        settled = moved.where("prob = 0 OR prob = 1")
        done = settled if done is None else done.unionByName(settled)
        blocks = math.ceil(2 * blocks / block_rows)
        rows = moved.where("prob > 0 AND prob < 1").withColumn("block", F.pmod(F.xxhash64(F.col(ident), F.lit(seed + blocks)), F.lit(blocks)))
    return done.select(ident, "source", "tokens", (F.col("base") + F.col("prob").cast("int")).alias("repeats"))


def report(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source: documents used, largest repeat, tokens drawn, actual share (null when nothing was drawn), wanted tokens
    and share, short: every document was used as often as it may be and the wanted tokens were not reached."""
    got = drawn.groupBy("source").agg(
        F.count(F.when(F.col("repeats") > 0, 1)).alias("docs_used"), F.max("repeats").alias("most_repeats"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens_drawn")
    )
    t = planned.join(got, "source", "left").fillna(0, ["docs_used", "most_repeats", "tokens_drawn"])
    whole = got.agg(F.sum("tokens_drawn").alias("n")).scalar()
    # all documents at their cap and still not enough
    short = (F.col("tokens_drawn") >= F.col("max_repeat") * F.col("available")) & (F.col("tokens_drawn") < F.col("wanted"))
    return t.select(
        "source", "target_share", F.try_divide("tokens_drawn", whole).alias("actual_share"), "max_repeat", "most_repeats", "docs", "docs_used", "available", "wanted", "tokens_drawn", short.alias("short")
    )
