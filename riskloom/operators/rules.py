"""The phrase score of a call, for a whole Arrow batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions.scoring import GENERIC_HIT, TYPE_HIT
from ..lexicon import DEFAULT, Lexicon
from .phrases import Matcher

RULE = "struct<score:double,fraud_type:string,signals:array<string>>"


def rule_of(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """struct(score, fraud_type, signals): `scoring.rule_score` of the hits of `facts.type_hits` and `scoring.generic_hits`.

    As an expression, each of the lexicon's phrases is a search of its own through every text. Here the phrases are found
    together, by a `Matcher`. No row leaves its partition.
    """
    scorer = RuleScorer(lexicon)

    @F.arrow_udf(RULE)
    def rule(texts: pa.Array) -> pa.Array:
        return scorer(texts)

    return rule(text)


class RuleScorer:
    """A lexicon made ready for many texts."""

    def __init__(self, lexicon: Lexicon):
        self.types = list(lexicon.keywords)
        listed = [(word, rank) for rank, kws in enumerate(lexicon.keywords.values()) for word in kws]
        # distinct, in the order of the lexicon, which is the order of signals
        self.words = list(dict.fromkeys([*(word for word, _ in listed), *lexicon.generic]))
        place = {word: i for i, word in enumerate(self.words)}
        # how often a type names a phrase; the last column counts the generic ones
        self.weight = np.zeros((len(self.words), len(self.types) + 1), np.int64)
        for word, rank in listed:
            self.weight[place[word], rank] += 1
        for word in lexicon.generic:
            self.weight[place[word], -1] += 1
        self.everywhere = place.get("")
        self.matcher = Matcher(self.words)

    def __call__(self, texts: pa.Array) -> pa.Array:
        found = self.matcher(texts)
        ends, place = found.offsets.to_numpy(), found.values.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        if self.everywhere is not None:  # an empty phrase is in every text there is
            some = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            row, place = np.concatenate([row, some]), np.concatenate([place, np.full(len(some), self.everywhere)])
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
        width = self.weight.shape[1]
        hit, kind = np.nonzero(self.weight[place])
        counts = np.bincount(row[hit] * width + kind, self.weight[place[hit], kind], len(texts) * width).reshape(-1, width)
        by_type = counts[:, :-1]
        best = by_type.argmax(axis=1)  # of equal types the earlier one
        n = by_type[np.arange(len(texts)), best]
        score = np.minimum(n * TYPE_HIT + counts[:, -1] * GENERIC_HIT, 1.0)
        fraud_type = pa.array(self.types, pa.string()).take(pa.array(best, mask=n == 0))
        signals = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.words, pa.string()).take(pa.array(place)))
        return pa.StructArray.from_arrays([pa.array(score), fraud_type, signals], ["score", "fraud_type", "signals"])
