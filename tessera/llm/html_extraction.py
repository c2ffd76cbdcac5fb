"""HTML extraction: flat text blocks classified by a decision tree over their own and their neighbours' features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.html_blocks import FEATURES, blocks, features
from tessera.llm.html_labels import PAGES
from tessera.llm.shared import table

DEPTH = 10


def labelled(spark: SparkSession, pages=PAGES, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(features, label): a row for each block of the labelled pages; features that are not in names are zero."""
    rows, used = [], np.array([n in names for n in FEATURES])
    for page, letters in pages:
        found = blocks(page)
        if len(found) != len(letters):
            raise ValueError(f"{len(found)} blocks, {len(letters)} labels: {page[:80]}")
        rows += [(Vectors.dense(np.where(used, x, 0.0)), float(y == "y")) for x, y in zip(features(found), letters, strict=True)]
    return spark.createDataFrame(rows, ["features", "label"])


def train(spark: SparkSession, pages=PAGES, depth: int = DEPTH, names: tuple[str, ...] = FEATURES) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=7).fit(labelled(spark, pages, names).coalesce(1))


class Tree:
    """The trained tree as arrays, so that tasks judge all blocks of a batch at once."""

    def __init__(self, model: DecisionTreeClassificationModel) -> None:
        rows: list[list[float]] = []  # feature (-1: leaf), threshold, left, right, class

        def add(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, at, at, node.prediction()])
            if node.subtreeDepth():
                rows[at][:2] = [node.split().featureIndex(), node.split().threshold()]
                rows[at][2] = add(node.leftChild())
                rows[at][3] = add(node.rightChild())
            return at

        add(model._call_java("rootNode"))
        table_ = np.array(rows)
        self.feature, self.left, self.right = (table_[:, k].astype(int) for k in (0, 2, 3))
        self.threshold, self.main, self.depth = table_[:, 1], table_[:, 4] > 0.5, model.depth

    def is_main(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), dtype=int), np.arange(len(x))
        for _ in range(self.depth):
            left = x[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(left, self.left[at], self.right[at])
        return self.main[at]


def extract(pages: DataFrame, html: str = "html", model: DecisionTreeClassificationModel | None = None) -> DataFrame:
    """pages with struct ``main``: text, n_blocks (of the page), n_kept.

    The text is the blocks that the tree takes for main text, in page order, divided by two line feeds. A null, an
    empty page and one without main text give the empty text. Every row is read whole and by itself, repeated ones
    too; unclosed elements, comments and quotes end with the page. An empty table stays empty. Columns of pages stay;
    one named ``main`` is replaced.
    """
    tree = Tree(model or train(pages.sparkSession))

    @F.pandas_udf("struct<text:string,n_blocks:int,n_kept:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(page) for page in batch]
            rows = [row for page in found for row in features(page)]
            kept = tree.is_main(np.array(rows)) if rows else np.zeros(0, dtype=bool)
            ends = np.cumsum([len(page) for page in found])
            text, number = [], []
            for page, end in zip(found, ends.tolist(), strict=True):
                own = [b.text for b, k in zip(page, kept[end - len(page) : end], strict=True) if k]
                text.append("\n\n".join(own))
                number.append(len(own))
            yield pd.DataFrame({"text": text, "n_blocks": [len(p) for p in found], "n_kept": number}).astype({"n_blocks": "int32", "n_kept": "int32"})

    return pages.withColumn("main", run(F.coalesce(F.col(html), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "main.text", F.length("main.text").cast("long").alias("n_chars"), "main.n_blocks", "main.n_kept"
    )
