"""Language identification: the family first, then linear SVMs between its languages.

Texts become hashed counts of letter 1- to 3-grams.  Families are found from the data: mean
profiles of the languages are merged while they are most alike.  A linear SVM for each family
picks the family; one SVM for each pair of its languages votes on the language.  Models are
trained by Spark tasks, one for each pair, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import Scratch, held_out, map_rows

WIDTH = 4096
#: Labelled rows a language that are learned from, on average over the draw by hash.
ROWS_PER_LANGUAGE = 1000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def profile(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Square roots of hashed n-gram counts, length 1; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, 32)
    code = code[is_letter | np.r_[True, is_letter[:-1]]]  # one space between words
    code = np.r_[32, code, 32].astype(np.uint64)
    x = code * np.uint64(0x9E3779B97F4A7C15)
    two = x[:-1] * np.uint64(3) + (x[1:] >> np.uint64(7))
    three = two[:-1] * np.uint64(5) + (x[2:] >> np.uint64(13))
    out = np.zeros(WIDTH, np.int64)
    for grams in (x, two, three):
        mixed = grams * np.uint64(0xD6E8FEB86659FD93)
        out += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=WIDTH)
    root = np.sqrt(out, dtype=np.float32)
    return root / np.float32(np.sqrt(out.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and offset of a squared-hinge SVM by accelerated gradient steps; classes weigh alike."""
    z = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    share = share.astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    rate = 1 / (4.0 + l2)  # rows have length sqrt(2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        grad = l2 * v - 2 * z.T @ (share * y * slack)
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    families: list[list[str]]
    family_weights: np.ndarray  # one row a family
    pairs: dict[tuple[str, str], np.ndarray]  # positive: the first

    def predict(self, profile: np.ndarray | None) -> tuple[str, float]:
        if profile is None or not self.families:
            return UNKNOWN, 0.0
        z = np.append(profile, np.float32(1))
        margin = 4 * (self.family_weights @ z)
        chance = np.exp(margin - margin.max())
        chance /= chance.sum()
        family = int(chance.argmax())
        names = self.families[family]
        votes = dict.fromkeys(names, 0.0)
        sure = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = 1 / (1 + np.exp(-4 * float(self.pairs[a, b] @ z)))
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        best = max(names, key=lambda n: (votes[n], sure[n]))
        within = sure[best] / (len(names) - 1) if len(names) > 1 else 1.0
        return best, float(np.clip(chance[family] * within, 0, 1))


def find_families(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Merge the two most alike groups of languages until about sqrt(languages) are left."""
    groups = [[i] for i in range(len(names))]
    alike = means @ means.T
    while len(groups) > max(1, int(np.ceil(np.sqrt(len(names))))):
        a, b = max(
            combinations(range(len(groups)), 2),
            key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean(),
        )
        groups[a] += groups.pop(b)
    return [sorted(names[i] for i in g) for g in groups]


def _profiles(rows: DataFrame) -> DataFrame:
    def body():
        letters = letter_table()

        def kernel(batch):
            made = [profile(t.as_py(), letters) for t in batch.column(1)]
            return {
                "lang": batch.column(0),
                "x": [None if p is None else p.tobytes() for p in made],
            }

        return kernel

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])
    return map_rows(rows.select("lang", "text"), body, schema).filter("x IS NOT NULL")


def fit_languages(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of the rows that are not held out.

    Texts are drawn by a hash, each once however many rows hold it, so that about
    ``rows_per_language`` of each language remain at most; nothing else of the model depends on the size of the table.  Without labelled rows
    the model knows no language and predicts ``und``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "languages")
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, WIDTH + 1), np.float32), {})
    shares = spark.createDataFrame(
        [(k, min(1.0, rows_per_language / n)) for k, n in counts.items()], "lang string, share double"
    )
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    drawn = usable.join(F.broadcast(shares), "lang").filter(draw).select("lang", "text").distinct()
    sample = scratch.keep(_profiles(drawn))

    means = sample.groupBy("lang").applyInPandas(_mean_profile, "lang string, x binary").collect()
    means.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in means]
    families = find_families(names, np.stack([np.frombuffer(r["x"], np.float32) for r in means]))
    # A task for each model; a language takes part in its family's pairs and in all family models.
    tasks = []
    for f, members in enumerate(families):
        for name in names:
            keep = min(1.0, 2.0 / len(names))
            tasks.append((f"family {f}", name, 1.0 if name in members else -1.0, keep))
        for a, b in combinations(members, 2):
            tasks += [(f"{a}\x00{b}", a, 1.0, 1.0), (f"{a}\x00{b}", b, -1.0, 1.0)]
    plan = spark.createDataFrame(tasks, "task string, lang string, y float, share double")
    dealt = sample.join(F.broadcast(plan), "lang").filter(
        F.pmod(F.xxhash64("x", "task"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    )
    fitted = dealt.groupBy("task").applyInPandas(_train, "task string, w binary").collect()
    weights = {r["task"]: np.frombuffer(r["w"], np.float32) for r in fitted}
    none = np.zeros(WIDTH + 1, np.float32)
    return LanguageModel(
        families,
        np.stack([weights.get(f"family {f}", none) for f in range(len(families))]),
        {
            (a, b): weights.get(f"{a}\x00{b}", none)
            for members in families
            for a, b in combinations(members, 2)
        },
    )


def _rows(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1)


def _mean_profile(rows: pd.DataFrame) -> pd.DataFrame:
    mean = _rows(rows["x"]).mean(axis=0)
    mean /= np.sqrt((mean**2).sum())
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "x": [mean.astype(np.float32).tobytes()]})


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("x")
    w = fit_svm(_rows(rows["x"]), rows["y"].to_numpy(np.float32))
    return pd.DataFrame({"task": rows["task"].iloc[:1].to_numpy(), "w": [w.tobytes()]})


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """``id, lang_pred, family, score`` for every row; only the text is looked at.

    A null text, an empty one or one without a letter is ``und`` with score 0.  Repeated rows
    keep their rows; a null id stays null; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body():
        letters = letter_table()
        model = held.value
        family = {n: "-".join(f) for f in model.families for n in f}

        def kernel(batch):
            found = [model.predict(profile(t.as_py(), letters)) for t in batch.column(1)]
            return {
                id_col: batch.column(0),
                "lang_pred": [f[0] for f in found],
                "family": [family.get(f[0]) for f in found],
                "score": [f[1] for f in found],
            }

        return kernel

    schema = T.StructType(
        [
            docs.select(id_col).schema[0],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("family", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return map_rows(docs.select(id_col, "text"), body, schema)
