"""Operator 12: spelling variants by composing finite-state machines.

Two words are near if one edit of a code point turns one into the other: the pairs that the
composition of the vocabulary's minimised acceptor, a one-edit transducer and the acceptor again
accepts. The composition is enumerated by initial state. Before the edit both words are in one
state of the acceptor, that of the code points they begin with, and after it they end alike. So the
words of one length, and those that are one longer, are dealt out twice: by what they begin with,
up to the middle, for edits behind it, and by what they end with, for edits before it. Each such
part of the vocabulary has its own small acceptor and is composed in one task.

A part with more than PART words, or with more than MIDDLE code points still to compare, is dealt
out again in the same way by the middle of what is left, as often as it takes: a part with one
code point left holds no more words than two of them can spell. A word alone in its part ends there.

What a task returns is counted per word and part, so that no pair of words is ever written.

Words: maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased. If 199 divides the crc32 of
`<doc_id>:<run>`, the code point of that number, modulo the run's length, is left out.

Defined cases: null and empty texts have no words; a null id is written as empty text; repeated
rows count as often as they occur; of near words that are equally frequent the smallest in
code-point order is the form; an empty table gives no rows; columns besides the id and the text are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.acceptors import Acceptors
from breachlens.llm.common import arrow_schema, as_batch, lower_bytes, released, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a code point.
DAMAGED = 199
#: Words of a part, and code points left to compare in it, beyond which it is dealt out again.
PART, MIDDLE = 10_000, 64
#: Words that a task counts before it sends them on.
HELD = 150_000
#: A form is at least so many times as frequent; so no word is this many steps from its root.
TIMES, STEPS = 5, 32


def runs(text: str | None, doc_id: int | None, least: int) -> Counter:
    """How often each word of at least `least` code points occurs in a text."""
    plain = lower_bytes(text).decode("utf-8", "surrogatepass")
    prefix, out = crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(RUN.findall(plain)).items():
        if len(run) >= least:
            h = crc32(run.encode(), prefix)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least:
                    continue
            out[run] += n
    return out


def vocabulary(docs: DataFrame, least_length: int, least_n: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the words of a corpus, counted within tasks first."""
    ddl = "word string, n bigint"
    schema = arrow_schema(ddl)

    def task(batches):
        held: Counter = Counter()

        def emit():
            return as_batch({"word": list(held), "n": list(held.values())}, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(runs(text.as_py(), doc_id.as_py(), least_length))
                if len(held) >= HELD:
                    yield emit()
                    held.clear()
        yield emit()

    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return counted.mapInArrow(task, ddl).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


_KEY = ("short", "head", "tail", "head_text", "tail_text", "unlike")


def _halved(parts: DataFrame) -> DataFrame:
    """Deal parts out by the middle of what their words have left: by the first half for edits in
    the second one, and by the second half for edits in the first. The latter must differ in their
    first `unlike` code points, so that no pair is found twice."""
    half = F.col("head") + F.floor((F.col("short") - F.col("head") - F.col("tail")) / 2).cast("int")
    behind = F.col("short") - half
    before = F.struct(
        "short", half.alias("head"), "tail", F.expr("substring(word, 1, half)").alias("head_text"), "tail_text", "unlike"
    )
    after = F.struct(
        "short", "head", behind.alias("tail"), "head_text", F.expr("right(word, short - half)").alias("tail_text"),
        half.alias("unlike"),
    )
    return parts.withColumn("half", half).select("word", "n", F.explode(F.array(before, after)).alias("key")).select(
        "word", "n", *[f"key.{c}" for c in _KEY]
    )


def parts_of(words: DataFrame) -> DataFrame:
    """(word, n, key): each word in its parts, none of which is large; two words that are near
    are together in exactly one of them. `short` is the length of the shorter words of a part."""
    spark = words.sparkSession
    length = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short"))
    parts = _halved(lengths.select(
        "word", "n", "short", F.lit(0).alias("head"), F.lit(0).alias("tail"),
        F.lit("").alias("head_text"), F.lit("").alias("tail_text"), F.lit(0).alias("unlike"),
    ))
    done, left = [], F.col("short") - F.col("head") - F.col("tail")
    while True:
        sizes = parts.groupBy(*_KEY).agg(F.count("*").alias("size")).where("size > 1")
        again = sizes.where((left > 1) & ((F.col("size") > PART) | (left > MIDDLE))).select(*_KEY)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, [*done, parts])
        again = staged(spark, again, "spelling-keys")
        done.append(parts.join(again, list(_KEY), "left_anti"))
        parts = _halved(staged(spark, parts.join(again, list(_KEY), "left_semi"), "spelling-parts"))


def _compared(parts: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word of a part its near words there, counted, and the
    most frequent of them, with its frequency turned negative, so that the least is the best."""
    ddl = "word string, n_near bigint, best struct<n: bigint, word: string>"
    schema = arrow_schema(ddl)

    def compose(words: list[str], counts: list[int], short: int, head: int, tail: int, unlike: int) -> dict:
        """word -> [n_near, -n, form]"""
        of, found, machine = {}, {}, Acceptors()
        for word, n in zip(words, counts):
            of[word[head:len(word) - tail]] = (word, n)
        left = short - head - tail
        shorter = machine.accept(sorted(w for w in of if len(w) == left))
        longer = machine.accept(sorted(w for w in of if len(w) > left))
        for a, b in chain(machine.replaced(shorter), machine.deleted(longer, shorter)):
            (a, n_a), (b, n_b) = of[a], of[b]
            if unlike and a[:unlike] == b[:unlike]:
                continue
            for word, other, n in ((a, b, n_b), (b, a, n_a)):
                best = found.get(word)
                if best is None:
                    found[word] = [1, -n, other]
                else:
                    best[0] += 1
                    if (-n, other) < (best[1], best[2]):
                        best[1], best[2] = -n, other
        return found

    def rows(key, words, counts):
        found = compose(words, counts, *key[:3], key[5])
        return [(w, k, {"n": n, "word": form}) for w, (k, n, form) in found.items()]

    def task(batches):
        key, words, counts, out = None, [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _KEY]
            for word, n, *this in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), *columns):
                if this != key:
                    if len(words) > 1:
                        out += rows(key, words, counts)
                    key, words, counts = this, [], []
                words.append(word)
                counts.append(n)
            if len(out) > 10_000:
                yield as_batch(dict(zip(("word", "n_near", "best"), zip(*out))), schema)
                out = []
        if len(words) > 1:
            out += rows(key, words, counts)
        if out:
            yield as_batch(dict(zip(("word", "n_near", "best"), zip(*out))), schema)

    dealt = parts.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return dealt.select("word", "n", *_KEY).mapInArrow(task, ddl)


def group_variants(
    docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = TIMES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary: how many words
    are near, the most frequent of them if it is `times` as frequent, and where forms lead to."""
    spark = docs.sparkSession
    with released(spark):
        words = staged(spark, vocabulary(docs, least_length, least_n, id_col, text_col), "spelling-words")
        near = _compared(parts_of(words)).groupBy("word").agg(
            F.sum("n_near").alias("n_near"), F.min("best").alias("best")
        )
        found = staged(spark, words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(-F.col("best.n") >= times * F.col("n"), F.col("best.word")).alias("form"),
            F.when(-F.col("best.n") >= times * F.col("n"), -F.col("best.n")).alias("form_n"),
        ), "spelling-forms")
        # Where a word leads to, by steps that double. A step multiplies the frequency, so there are few.
        leads = found.where("form is not null").select("word", F.col("form").alias("root"))
        steps = 1
        while steps < STEPS:
            further = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
            jumped = staged(spark, leads.join(further, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ), "spelling-roots")
            leads, steps = jumped.select("word", "root"), 2 * steps
            if jumped.where("moved").isEmpty():
                break
    return found.join(leads, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
