"""Language of short texts without telling words, by their runs of three letters: the fallback of ``query_language``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def letter_runs(text: Column) -> Column:
    """array<string>: runs of three characters of each word in lower case, with a blank at its begin and end."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


@dataclass
class LetterModel:
    """Log probabilities of runs by language; unknown runs have ``floor``."""

    weights: dict[str, dict[str, float]]
    floor: dict[str, float]

    def guess(self, text: str | None, default: str) -> str:
        runs = [p[i : i + 3] for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() for p in [f" {w} "] for i in range(len(p) - 2)]
        if not runs or not self.weights:
            return default
        score = {lang: sum(w.get(r, self.floor[lang]) for r in runs) for lang, w in self.weights.items()}
        best = max(sorted(score), key=score.__getitem__)
        return best if score[best] > score.get(default, -math.inf) else default

    def column(self, text: Column, default: str = "en") -> Column:
        """The most likely language; ``default`` for null and blank texts and where nothing is more likely."""

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield s.map(lambda t: self.guess(t, default))

        return F.pandas_udf(run, StringType())(F.coalesce(text, F.lit("")))


def fit_letters(df: DataFrame, text: str, label: str, langs: tuple[str, ...] = ("en", "fr"), most: int = 4000) -> LetterModel:
    """Counted over all labelled rows; the ``most`` most frequent runs of each language are kept, which bounds what is sent."""
    from tamarack.operators.ranking import top_k

    d = df.where(F.col(label).isin(*langs)).select(F.col(label).alias("l"), F.explode(letter_runs(F.col(text))).alias("r"))
    n = d.groupBy("l", "r").agg(F.count("*").alias("n"))
    total = {r["l"]: r["n"] for r in n.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    weights: dict[str, dict[str, float]] = {lang: {} for lang in total}
    for r in top_k(n, ["l"], [F.desc("n"), F.asc("r")], most, "k").collect():
        weights[r["l"]][r["r"]] = math.log(r["n"] / total[r["l"]])
    return LetterModel(weights, {lang: math.log(0.5 / t) for lang, t in total.items()})
