"""The whole analysis as one lazy plan: documents to verbs, predictions, group probabilities, means.

Stages compose as DataFrames, without files in between; each can also be read from and written to files.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from verbatlas.functions.providers import ContextCountLM
from verbatlas.operators import extract, frequency, groups


@dataclass
class Options:
    size: int = 2_000_000
    overlap: int = 5_000
    include_aux: bool = True
    top_k: int = 10
    least: int | None = None
    most: int | None = None
    profile: str = "standard"
    threshold: float = 0.5
    providers: dict[str, Any] = field(default_factory=dict)


@dataclass
class Stages:
    sentences: DataFrame
    verbs: DataFrame
    predictions: DataFrame
    probabilities: DataFrame
    means: DataFrame
    best: DataFrame


def analyse(docs: DataFrame, group_table: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> Stages:
    """All stages; nothing runs until one of them is used."""
    o = options or Options()
    tagger, model = o.providers.get("tagger"), o.providers.get("masked_lm")
    chunks = extract.char_chunks(docs.select(id_col, text_col), text_col, o.size, o.overlap)
    sents = extract.unique_sentences(extract.sentences(chunks, splitter=o.providers.get("splitter")), [id_col])
    verbs = extract.verbs(sents, tagger, o.include_aux)
    if o.least is not None or o.most is not None:
        verbs = frequency.filter_by_count(verbs, "lemma", o.least, o.most)
    rows = extract.with_context(verbs, tagger)
    model = model or ContextCountLM(extract.trigrams(sents, tagger))
    preds = model.predict(rows, o.top_k)
    probs = groups.row_probabilities(preds, group_table, o.profile, o.providers.get("lemmatizer"))
    names = probs.columns[len(preds.columns) :]
    means = groups.lemma_means(probs, names)
    return Stages(sents, verbs, preds, probs, means, groups.best_groups(means, o.threshold))
