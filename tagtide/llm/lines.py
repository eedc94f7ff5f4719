"""Line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import free_name, map_batches, utf8
from tagtide.session import durable

#: Polynomial hashes modulo 2**64; the inverse takes a deleted character out of the powers.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: So many rows of 28 bytes are sent to all tasks at most.
FEW = 500_000
BLANK = " \t\x0b\x0c\r"


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_keys(line: str) -> list[int]:
    """Keys of the outer halves. Two lines one edit apart share one of them: the edit touches one half only.

    The half has (n - 1) // 2 or n // 2 characters, so lines of n and n + 1 characters have one in common.
    """
    n, digest = len(line), xxhash.xxh3_64_intdigest
    keys = []
    for half in {(n - 1) // 2, n // 2}:
        keys.append(digest(line[:half].encode("utf-8", "surrogatepass"), half))
        keys.append(digest(line[n - half :].encode("utf-8", "surrogatepass"), ~half & 0xFFFFFFFF))
    return keys


def variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all variants with one character deleted, and the key of the line itself.

    The first array has for every place a key of (variant, place): lines that share one differ by a
    substitution there. The second has a key of every variant and, last, of the line: a line that
    equals a variant of another lacks one character of it.
    """
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    powers = np.empty(n, np.uint64)
    if n:
        powers[0] = 1
        powers[1:] = BASE
        powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(points + np.uint64(1)) * powers, dtype=np.uint64)])
    shorter = sums[:-1] + (sums[-1] - sums[1:]) * INVERSE
    sizes = np.array([n, n + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    plain = scramble(shorter + sizes[0])
    placed = scramble(plain ^ scramble(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))
    own = scramble(sums[-1:] + sizes[1:])
    return placed, np.concatenate([plain, own])


def digest_of(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def lines_of(docs: DataFrame, *, id: str, text: str, min_chars: int, content: bool) -> DataFrame:
    """Lines with a word: (line, doc, no, halves), or (line, content) of those that may have near ones."""

    def run(batch):
        keys, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(keys), 256):
            out: tuple[list, ...] = ([], [], [], [])
            for key, raw in zip(keys[at : at + 256], raws[at : at + 256]):
                for no, line in enumerate(raw.decode("utf-8", "surrogatepass").split("\n")):
                    if not line.strip(BLANK):
                        continue
                    long_enough = len(line) >= min_chars
                    if content:
                        if long_enough:
                            out[0].append(digest_of(line))
                            out[1].append(line.encode("utf-8", "surrogatepass"))
                        continue
                    halves = half_keys(line) if long_enough else []
                    for column, value in zip(out, (digest_of(line), key, no, [h - (1 << 63) for h in halves])):
                        column.append(value)
            yield {"line": out[0], "content": out[1]} if content else {"line": out[0], "doc": out[1], "no": out[2], "halves": out[3]}

    rows = docs.select(F.col(id).cast("long").alias("id"), utf8(text))
    return map_batches(rows, run, "line binary, content binary" if content else "line binary, doc long, no int, halves array<long>")


def order():
    """Lines in order of document and place."""
    return F.struct("doc", "no")


def near_earlier(docs: DataFrame, classes: DataFrame, *, id: str, text: str, min_chars: int) -> DataFrame:
    """(line): distinct lines that have an earlier line within one edit. ``classes`` has (line, first, halves)."""
    halves = classes.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    suspects = halves.join(shared, "half").select("line").distinct()
    suspects = durable(classes.select("line", "first").join(suspects, "line", "left_semi"))
    pages = lines_of(docs, id=id, text=text, min_chars=min_chars, content=True)
    # Suspects are counted: a few go to all tasks, so that only their lines travel; more meet them by line.
    few = suspects.count() <= FEW
    found = durable(pages.join(F.broadcast(suspects) if few else suspects, "line").dropDuplicates(["line"]).select("line", "first", "content"))

    def run(batch):
        firsts = batch.column(0)
        for at, raw in enumerate(batch.column(1).to_pylist()):
            placed, plain = variants(raw.decode("utf-8", "surrogatepass"))
            keys = np.concatenate([placed, plain]).view(np.int64)
            kind = np.zeros(len(keys), np.int8)  # 0 substitution, 1 deletion, 2 the line itself
            kind[len(placed) :] = 1
            kind[-1] = 2
            for a in range(0, len(keys), 200_000):
                part = keys[a : a + 200_000]
                yield {"key": part, "kind": kind[a : a + 200_000], "first": firsts.take(pa.array(np.full(len(part), at)))}

    shape = "struct<doc: bigint, no: int>"
    keyed = map_batches(found.select("first", "content"), run, f"key long, kind tinyint, first {shape}")
    # Lines that share a substitution are all one edit apart; of those around a deletion, the line itself
    # is one edit from each. So the earliest of a key tells enough, and no pairs of a group are made. A
    # key holds at most as many lines as there are characters, at one place or each place.
    by_key = Window.partitionBy("key")
    own = F.max(F.when(F.col("kind") == 2, F.col("first"))).over(by_key)
    earliest = F.min("first").over(by_key)
    other = F.when(F.col("kind") == 1, own).otherwise(earliest)
    pairs = keyed.select("first", other.alias("other")).where("other < first").distinct()
    texts = found.select("line", "first", "content")
    verified = (
        pairs.join(texts, "first")
        .join(texts.select(F.col("first").alias("other"), F.col("content").alias("before")), "other")
        .where(F.levenshtein(F.col("content").cast("string"), F.col("before").cast("string"), 1) >= 0)
    )
    return verified.select("line").distinct()


def removed_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 16) -> DataFrame:
    """(doc, no, line): the lines to remove, by document and place.

    A line goes if an equal line, or one within one edit (insertion, deletion or substitution of a
    character), comes earlier in order of document and place, whether or not that one stays. Lines
    without words always stay, and lines under ``min_chars`` characters only fall to equal ones.
    """
    docs = docs.where(F.col(id).isNotNull())
    lines = lines_of(docs, id=id, text=text, min_chars=min_chars, content=False)
    classes = durable(lines.groupBy("line").agg(F.min(order()).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")))
    near = near_earlier(docs, classes, id=id, text=text, min_chars=min_chars)
    gone = durable(near.select("line", F.lit(True).alias("near")))
    decided = classes.join(gone, "line", "left").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"), "n")
    touched = durable(decided.where("near OR n > 1").drop("n"))
    places = lines.select("line", "doc", "no")
    return places.join(touched, "line").where(F.col("near") | (order() > F.col("first"))).select("doc", "no", "line")


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 16, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that ``removed_lines`` tells, kept lines joined as before.

    All columns stay; a column ``n_chars`` is brought in line with the text. ``counts`` adds ``n_lines``
    and ``n_removed``. A document may lose all its lines and stays with an empty text; a null text
    stays null; rows with equal ids count as one document, so equal rows keep the same lines; rows with
    a null id have no place in the order, are not compared and stay as they are; no rows give no rows.
    """
    gone = removed_lines(docs, id=id, text=text, min_chars=min_chars)
    key, drop = free_name(docs, "_dedup_doc"), free_name(docs, "_dedup_lines")
    entries = F.collect_set(F.struct("no", F.substring("line", 1, 8).alias("line")))
    lists = gone.groupBy(F.col("doc").alias(key)).agg(entries.alias(drop))
    joined = docs.join(lists, F.col(id).cast("long") == F.col(key), "left").drop(key)
    names = docs.columns
    has_length = "n_chars" in names and docs.schema["n_chars"].dataType.typeName() in ("long", "integer")

    def run(batch):
        columns = dict(zip(batch.schema.names, batch.columns))
        texts, totals, removed = [], [], []
        for page, out in zip(columns[text].to_pylist(), columns[drop].to_pylist()):
            lines = page.split("\n") if page is not None else []
            before = len(lines)
            if out and page is not None:
                places: dict[int, set[bytes]] = {}
                for entry in out:
                    places.setdefault(entry["no"], set()).add(entry["line"])
                lines = [x for no, x in enumerate(lines) if no not in places or digest_of(x)[:8] not in places[no]]
            texts.append(page if page is None or len(lines) == before else "\n".join(lines))
            totals.append(before)
            removed.append(before - len(lines))
        columns[text] = texts
        if has_length:
            lengths = columns["n_chars"].to_pylist()
            columns["n_chars"] = [n if not r else len(t) for n, r, t in zip(lengths, removed, texts)]
        return columns | {"n_lines": totals, "n_removed": removed}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if counts:
        schema += ", n_lines long, n_removed long"
    return map_batches(joined, run, schema)
