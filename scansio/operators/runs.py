"""Run names, parameter grids and run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parameter grids of the published sweeps.
LANGUAGES = ["es", "ge", "en", "multi"]
MULTILINGUAL_MODELS = [
    "bert,bert-base-multilingual-cased", "distilbert,distilbert-base-multilingual-cased",
    "roberta,roberta-base", "roberta,roberta-large", "xlmroberta,xlm-roberta-base",
    "xlmroberta,xlm-roberta-large", "electra,google/electra-base-discriminator",
]
# The second list has two models more.
RECURRENT_MODELS = [*MULTILINGUAL_MODELS, "albert,albert-base-v2", "albert,albert-large-v2"]
SWEEPS: dict[str, dict[str, list]] = {
    "multi": {
        "model_name": ["bert:bert-base-multilingual-cased", "roberta:roberta-base",
                       "xlmroberta:xlm-roberta-base"],
        "lang": ["es", "en", "de", "multi"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6, 15e-6],
    },
    "multi_large": {
        "model_name": ["roberta:roberta-large", "xlmroberta:xlm-roberta-large", "bert:bert-large-cased"],
        "lang": ["es", "en", "de", "multi"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6, 15e-6],
    },
    "en2": {
        "model_name": ["bert:bert-base-multilingual-cased", "roberta:roberta-base",
                       "xlmroberta:xlm-roberta-base", "bert:bert-base-cased", "roberta:roberta-large",
                       "xlmroberta:xlm-roberta-large", "bert:bert-large-cased"],
        "lang": ["en", "multi"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6],
    },
    "es": {
        "model_name": ["bert:dccuchile/bert-base-spanish-wwm-cased"],
        "lang": ["es"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6, 15e-6],
    },
    "en": {
        "model_name": ["bert:bert-base-cased"],
        "lang": ["en"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6, 15e-6],
    },
    "de": {
        "model_name": ["bert:bert-base-german-cased"],
        "lang": ["de"],
        "num_train_epochs": [10, 100],
        "learning_rate": [10e-6, 15e-6],
    },
}

# Parameters that are the same in all published sweeps.
SWEEP_CONSTANTS = {
    "warmup_ratio": [0.1], "weight_decay": [0.01], "max_seq_length": [24], "num_labels": [12],
    "eval_batch_size": [8], "train_batch_size": [8], "seed": [2021],
}



def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_name(*parts: Column | str) -> Column:
    """``tag-lang-type-model``; a slash in the model name becomes a dash."""
    return F.concat_ws("-", *[F.replace(_col(p), F.lit("/"), F.lit("-")) for p in parts])


def parse_models(df: DataFrame, column: str) -> DataFrame:
    """``type,name;type,name`` as rows ``model_type, model_name``."""
    rows = df.withColumn("pair", F.explode(F.split(column, ";")))
    fields = F.split("pair", ",")
    return (rows.withColumn("model_type", F.trim(F.get(fields, F.lit(0))))
            .withColumn("model_name", F.trim(F.get(fields, F.lit(1)))).drop("pair"))


def parse_langs(df: DataFrame, column: str) -> DataFrame:
    """``es, GE`` as rows ``run_lang``, lower-cased."""
    return df.withColumn("run_lang", F.explode(F.split(F.lower(column), ","))).withColumn(
        "run_lang", F.trim("run_lang"))


def lang_token(c: Column | str) -> tuple[Column, Column]:
    """Language and whether the extra corpus is wanted: a three-letter token that starts with g."""
    token = F.lower(F.trim(_col(c)))
    extra = token.startswith("g") & (F.length(token) == 3)
    return F.when(extra, F.substring(token, 2, 2)).otherwise(token), extra


def batch_size(model: Column | str) -> Column:
    """Rows per training batch of the tuned models."""
    return F.when(_col(model).contains("large"), 8).otherwise(32)


def accumulation_steps(model: Column | str) -> Column:
    return F.when(_col(model).contains("large"), 2).otherwise(1)


def expand_grid(df: DataFrame, parameters: Mapping[str, Sequence]) -> DataFrame:
    """Each row of ``df`` with every combination of the literal values."""
    for name, values in parameters.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid(spark: SparkSession, parameters: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of a sweep, one row each."""
    return expand_grid(spark.range(1), parameters).drop("id")


def pending_runs(runs: DataFrame, done: DataFrame, key: str = "run", overwrite: bool = False) -> DataFrame:
    """Runs without a finished namesake, or all of them."""
    return runs if overwrite else runs.join(done.select(key), key, "left_anti")


def best_run(runs: DataFrame, by: Sequence[str], order: str, objective: str = "accuracy") -> DataFrame:
    """The run with the largest objective per group; the earliest one among equals."""
    payload = F.struct(*[c for c in runs.columns if c not in (*by, order)])
    best = F.min_by(payload, F.struct(-F.col(objective), F.col(order)))
    return runs.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")
