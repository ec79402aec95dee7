"""From a raw panel to a model matrix: every statistic is fitted once, on training rows, and applied to any rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens import constants as C
from cohortlens.functions.numeric import named
from cohortlens.functions.text import literal, number, ordinal_code, quoted
from cohortlens.operators import columns as cols
from cohortlens.operators import encode, features, impute, scale, split, target
from cohortlens.session import materialize
from cohortlens.spec import Feature, PanelSpec

LABEL, SPLIT = "label", "split"


@dataclass
class Preparation:
    """Fitted statistics. All but the classes of nominal columns are bounded by the number of columns."""

    spec: PanelSpec
    numeric: list[str]
    ordinal: list[str]
    nominal: list[str]
    derived: list[Feature]
    fills: dict[str, float]
    text_fills: dict[str, str]
    means: dict[str, float]
    stds: dict[str, float]
    classes: DataFrame = field(repr=False)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.ordinal, *self.nominal, *[f.name for f in self.derived]]

    def fill(self, df: DataFrame, keep: list[str] = (), zero: bool = False) -> DataFrame:
        """The raw columns of training, missing ones and nulls filled with the fitted values (or 0)."""
        have = {f.name: f.dataType for f in df.schema.fields}

        def value(name, default, kind):
            own = (number(name, have[name]) if kind == "double" else f"cast({quoted(name)} AS string)") if name in have else "NULL"
            return f"cast(coalesce({own}, {literal(default)}) AS {kind}) AS {quoted(name)}"

        return df.selectExpr(
            *map(quoted, keep),
            *[value(c, 0 if zero else self.fills.get(c), "double") for c in self.numeric],
            *[value(c, self.text_fills.get(c), "string") for c in (*self.ordinal, *self.nominal)],
        )

    def encode(self, filled: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Derived features and numeric codes, in training order."""
        # derived features are made of numbers only; the joins come first, when rows are narrow
        coded = features.build(encode.apply(filled, self.classes, self.nominal), self.derived)
        levels = self.spec.ordinal_levels
        return coded.selectExpr(*map(quoted, keep), *[
            f"cast({ordinal_code(c, levels) if c in self.ordinal else quoted(c)} AS double) AS {quoted(c)}" for c in self.columns
        ])

    def standardize(self, encoded: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Values of rows without any statistic (an all-null training column) become 0."""
        def value(c):
            mean, std = self.means.get(c), self.stds.get(c)
            if mean is None:
                return f"0D AS {quoted(c)}"
            return f"coalesce(({quoted(c)} - ({literal(mean)})) / {literal(std or 1.0)}, 0D) AS {quoted(c)}"

        return encoded.selectExpr(*map(quoted, keep), *[value(c) for c in self.columns])

    def transform(self, df: DataFrame, keep: list[str] = (), zero: bool = False) -> DataFrame:
        """`keep` columns and the model matrix; each row's result depends on that row alone."""
        return self.standardize(self.encode(self.fill(df, keep, zero), keep), keep)

    def save(self, path: str) -> str:
        spark = self.classes.sparkSession
        state = {
            k: getattr(self, k) for k in ("numeric", "ordinal", "nominal", "fills", "text_fills", "means", "stds")
        }
        state["spec"] = self.spec.to_json()
        state["derived"] = [asdict(f) for f in self.derived]
        text = json.dumps(state, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preparation":
        state = json.loads(spark.read.text(f"{path}/state").head()[0])
        state["spec"] = PanelSpec.from_json(state["spec"])
        state["derived"] = [
            Feature(f["name"], f["kind"], tuple(f["inputs"]), tuple(f["params"])) for f in state["derived"]
        ]
        return cls(**state, classes=spark.read.parquet(f"{path}/classes"))


def labelled(df: DataFrame, spec: PanelSpec, year: int | None = None) -> DataFrame:
    """Rows with a target, with `label`; identifiers and leaking columns are gone."""
    goal = target.resolve(df.columns, year or spec.latest_year, spec.target)
    rows = target.binarize(df, goal, spec.target_mode, LABEL)
    clean = cols.drop_identifiers(rows, (spec.key,), spec.identifiers)
    return cols.drop_leakage(clean, (LABEL, spec.key), spec.target, spec.leakage, spec.leakage_match)


def fit_values(rows: DataFrame, spec: PanelSpec, missing: str = "median", engineered: bool = True,
               fit_on: str = "train") -> Preparation:
    """Fill values and class catalogs from the training part of labelled rows (`fit_on="all"`: from every row)."""
    if fit_on not in ("train", "all"):
        raise ValueError(f"fit_on is 'train' or 'all', not {fit_on!r}")
    train = rows.where(F.col(SPLIT) == "train")
    base = train if fit_on == "train" else rows
    own = [c for c in rows.columns if c not in (spec.key, LABEL, SPLIT)]
    kinds = dict(rows.dtypes)
    texts = [c for c in own if kinds[c] == "string"]
    ordinal = [c for c in texts if spec.ordinal_stem in c.upper()]
    nominal = [c for c in texts if c not in ordinal]
    numeric = [c for c in cols.numeric_columns(rows) if c in own]

    fills = {r["column"]: r["fill"] for r in impute.fit(base, numeric, missing).collect()}
    text_fills = {r["column"]: r["fill"] for r in impute.fit(base, texts, "mode").collect()} if texts else {}
    derived = features.default_features(numeric, spec) if engineered else []
    prep = Preparation(spec, numeric, ordinal, nominal, derived, fills, text_fills, {}, {}, None)
    if nominal:
        named_texts = train.select(*[F.coalesce(named(c), F.lit(text_fills.get(c))).alias(c) for c in nominal])
        prep.classes = encode.catalog(named_texts, nominal)
    else:
        prep.classes = rows.sparkSession.createDataFrame([], "column string, value string, index bigint")
    return prep


def fit_scale(prep: Preparation, encoded_train: DataFrame) -> None:
    """Means and deviations of the encoded training rows, one row of statistics per column."""
    for r in scale.fit(encoded_train, prep.columns).collect():
        prep.means[r["column"]], prep.stds[r["column"]] = r["mean"], r["std"]


def prepare(df: DataFrame, spec: PanelSpec, year: int | None = None, missing: str = "median", engineered: bool = True,
            fit_on: str = "train", test_size: float = C.TEST_SIZE, seed: int = C.SEED) -> tuple[DataFrame, Preparation]:
    """(key, label, split and standardised features, fitted preparation).

    Labelled rows and encoded rows are each written to the shared folder once, so no fit repeats the work before
    it. `missing="drop"` leaves out labelled rows with a gap; rows that are scored later are filled with the medians
    and modes of the others.
    """
    keep = [spec.key, LABEL, SPLIT]
    found = labelled(df, spec, year)
    if missing == "drop":
        found = impute.impute_all(found, "drop", (spec.key,))
    clean = materialize(found, "labelled")
    rows = split.stratified(clean, LABEL, spec.key, test_size, seed, SPLIT)  # a projection on written rows and cuts
    prep = fit_values(rows, spec, "median" if missing == "drop" else missing, engineered, fit_on)
    encoded = materialize(prep.encode(prep.fill(rows, keep), keep), "encoded")
    fit_scale(prep, encoded.where(F.col(SPLIT) == "train"))
    return prep.standardize(encoded, keep), prep
