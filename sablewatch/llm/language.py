"""Language by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A document is parsed from left to
right into the longest pieces found in that text. Its pieces are divided by those the language needs for
as much text of its own that its automaton has not seen, since automata of more text find longer
pieces in anything; the language with the fewest normalised pieces wins.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.llm.base import per_worker, slices
from sablewatch.session import materialised

#: The bounded training sample: passages of each language and characters of each passage.
PASSAGES, PASSAGE_CHARS = 150, 400
#: More languages than this cannot be held by a worker: learning then fails.
LANGUAGES = 500
#: Parts of a language's text that are parsed by the automaton of the others, to learn its rate.
FOLDS = 4
#: A text that needs more than so many times its language's pieces, and so many more, is in none.
FOREIGN, SPARE = 2.2, 10

_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-cased letters, everything between them one blank; empty without a letter."""
    words = _LETTERS.findall(text.lower()) if text else []
    return " ".join(words) + " " if words else ""


def suffix_automaton(text: str) -> dict:
    """The root of the automaton of all substrings; a state is a dict from character to state."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for own in moves:
        for c, to in own.items():
            own[c] = moves[to]
    return moves[0]


def pieces(text: str, root: dict) -> int:
    """Number of longest matches the text falls into; a character never seen is one alone."""
    n, state, start, alone = 1, root, root.get, {}
    for c in text:
        state = state.get(c)
        if state is None:
            n += 1
            state = start(c)
            if state is None:
                state = alone
    return n


def training_text(labelled: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> dict[str, str]:
    """A bounded sample of text per language: one passage of each of ``passages`` different texts
    (all if there are fewer), by the order of a hash, at a hashed place in the whole text.

    ``labelled`` has text and lang. Copies count once, however many there are.
    """
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("at")).where("text is not null and lang is not null")
    # The first of each salt, then of the language: a hot language is many groups first.
    first = rows.select("lang", "at").distinct().withColumn("salt", F.pmod("at", F.lit(32)))
    for by in (("lang", "salt"), ("lang",)):
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("k") <= passages)
    first = materialised(first.select("lang", "at"), "language-sample")
    if (n := first.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{n} languages; at most {LANGUAGES} can be learnt")
    chosen = F.broadcast(first)  # at most LANGUAGES x passages rows
    start = F.pmod(F.xxhash64("at"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    cut = F.col("text").substr(start.cast("int"), F.lit(chars))
    sample = rows.join(chosen, ["lang", "at"]).groupBy("lang", "at").agg(F.min(cut).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "at").collect():
        out.setdefault(r.lang, []).append(plain(r.text))
    return {lang: "\n".join(parts) for lang, parts in sorted(out.items())}


def rate(text: str, folds: int = FOLDS) -> float:
    """Pieces per character that a language needs for its own text, each part of it parsed by the
    automaton of the other parts; less one standard error of the count, so that a language of which
    little is known does not win by a rate that came out high."""
    words = text.split()
    size = max(1, len(words) // (folds * 8))
    parts = [" ".join(words[i : i + size]) + " " for i in range(0, len(words), size)]
    cost = length = 0
    for fold in range(min(folds, len(parts))):
        held = "".join(parts[fold::folds])
        cost += pieces(held, suffix_automaton("\n".join(p for i, p in enumerate(parts) if i % folds != fold)))
        length += len(held)
    return cost / length * (1 - 1 / (1 + cost) ** 0.5) if cost else 1.0


def learnt(sample: dict[str, str]) -> dict[str, tuple[str, float]]:
    """Text and rate of each language."""
    return {lang: (text, rate(text)) for lang, text in sample.items()}


def _judge(text: str | None, models: dict[str, tuple[dict, float]]) -> tuple[str, float, bool]:
    """Language, score, and whether the text is in that language at all."""
    letters = plain(text)
    if not letters or not models:
        return "und", 0.0, False
    cost = sorted((pieces(letters, root) / own, lang) for lang, (root, own) in models.items())
    best, lang = cost[0]
    second = cost[1][0] if len(cost) > 1 else (len(letters) + 1) / models[lang][1]
    own = models[lang][1]
    return lang, max(0.0, 1 - best / second), best * own <= FOREIGN * own * len(letters) + SPARE


def _models(shared):
    return per_worker("languages", shared.value, lambda: {k: (suffix_automaton(v), own) for k, (v, own) in shared.value.items()})


def predict(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score from whole texts; needs doc_id and text.

    ``sample`` is bounded (``training_text``) and broadcast. Null texts and texts without a letter
    are ``und`` with score 0, as is all if nothing was learnt. The score is the share of pieces
    the winner saves over the next language, both normalised; equal costs go to the first in alphabet, score 0.
    Repeated rows stay; other columns are not looked at; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learnt(sample))

    def run(batches):
        models = _models(shared)
        for batch in slices(batches):
            got = [_judge(t, models)[:2] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, schema)


def stage(docs: DataFrame) -> DataFrame:
    """The documents in a known language. Those without letters go, and those that need far more
    pieces than text of the winning language does (FOREIGN, SPARE). Without labels only texts without letters go."""
    sample = training_text(docs) if "lang" in docs.columns else {}
    shared = docs.sparkSession.sparkContext.broadcast(learnt(sample))
    at = docs.columns.index("text")

    def run(batches):
        models = _models(shared)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            keep = [_judge(t, models)[2] if models else bool(t and _LETTERS.search(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
