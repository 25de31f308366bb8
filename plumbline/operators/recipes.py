"""Fixed task recipes: how the components of a task are combined into its prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blend as B
from .guards import check_run, check_seeds

# Fixed values of the recorded recipes: mode, weight of each component, and whether a sigmoid follows.
BLENDS = {
    "cyp2d6_veith": ("rank", {"component_1": 0.4, "component_2": 0.3, "component_3": 0.2, "component_4": 0.1}, False),
    "cyp3a4_veith": ("logit", {"component_1": 0.2, "component_2": 0.3, "component_3": 0.3, "component_4": 0.2}, False),
    "dili": ("raw", {"component_1": 0.6, "component_2": 0.2, "component_3": 0.2}, False),
    "half_life_obach": ("zscore", {"component_1": 0.5, "component_2": 0.1, "component_3": 0.4}, False),
    "hia_hou": ("rank", {"gated_5seed": 0.1, "chemical_foldbag": 0.5, "chemical_logistic_trainonly": 0.4}, False),
    "lipophilicity_astrazeneca": ("raw", {"component_1": 0.2, "component_2": 0.1, "component_3": 0.3, "component_4": 0.4}, False),
    "pgp_broccatelli": ("logit", {"layerwise": 0.65, "kpgt_ept": 0.25, "kpgt": 0.1}, True),
    "solubility_aqsoldb": ("raw", {"fingerprint_xgb": 0.3, "metric_head": 0.3, "expanded_chemical_model": 0.4}, False),
    "vdss_lombardo": ("rank", {"component_1": 0.9, "component_2": 0.1}, False),
    "cyp3a4_substrate_carbonmangels": ("rank_n", {"r171": 1 / 3, "r207": 1 / 3, "r182": 1 / 3}, False),
}
SEED_GROUPS = {1: [1, 2, 3, 4, 5], 2: [11, 12, 13, 14, 15], 3: [21, 22, 23, 24, 25], 4: [31, 32, 33, 34, 35], 5: [41, 42, 43, 44, 45]}
NESTED = [
    ("base", {"c060": 1 / 3, "c070": 1 / 3, "c008": 1 / 3}),
    ("prior", {"base": 0.5, "kpgt_finetuned": 0.5}),
    ("staged", {"prior": 0.75, "kpgt_staged": 0.25}),
    ("out", {"staged": 0.75, "unimol": 0.25}),
]
SEEDED = {"clearance_microsome_az": ("mean", {}), "ppbr_az": ("raw", {"seedbag": 0.7, "fp_only": 0.3}), "cyp2d6_substrate_carbonmangels": ("zscore", {"seedbag_heads": 0.8, "xl": 0.1, "descriptor_sidecar_v2": 0.1})}


def run_seeds(df: DataFrame, task: str, run: int, component: str = "seedbag_heads") -> DataFrame:
    """The seed bag's rows of a formal run; its seeds must be exactly the run's."""
    check_run(run)
    bag = df.where(F.col("component") == component)
    check_seeds(sorted(r["seed"] for r in bag.select("seed").distinct().collect()), SEED_GROUPS[run])
    return bag


def predict(df: DataFrame, task: str, run: int = 1, names: list[str] | None = None) -> DataFrame:
    """(row_id, score) of a task from its long components (component, seed, row_id, score).

    A lone component called ``prediction`` is passed through. A blend takes the components of its record; ``names`` gives
    other names for them, in the record's order.
    """
    kinds = sorted(r["component"] for r in df.select("component").distinct().collect())  # a row for each component
    if kinds == ["prediction"]:
        return df.select("row_id", "score")
    if task in BLENDS:
        mode, weights, squash = BLENDS[task]
        names = names or list(weights)
        if len(names) != len(weights):
            raise ValueError(f"{task} takes {len(weights)} components")
        if missing := sorted(set(names) - set(kinds)):
            raise ValueError(f"missing components: {missing}")
        return B.blend(df.where(F.col("component").isin(names)), dict(zip(names, weights.values(), strict=True)), mode, squash=squash)
    if task == "clearance_hepatocyte_az":
        inputs = ["c060", "c070", "c008", "kpgt_finetuned", "kpgt_staged", "unimol"]
        if not set(inputs) <= set(kinds):
            raise ValueError(f"missing components: {sorted(set(inputs) - set(kinds))}")
        wide = df.groupBy("row_id").pivot("component", inputs).agg(F.first("score"))
        return B.nested_rank_blend(wide, NESTED)
    if task in SEEDED:
        how, weights = SEEDED[task]
        bag = run_seeds(df, task, run)
        if how == "mean":
            return B.seed_mean(bag)
        if how == "raw":
            both = B.seed_mean(bag).withColumn("component", F.lit("seedbag")).unionByName(df.where("component = 'fp_only'").select("row_id", "score", "component"))
            return B.blend(both, weights)
        seeds = bag.select("seed").distinct()
        fixed = df.where(F.col("component") != "seedbag_heads").drop("seed").join(F.broadcast(seeds), F.lit(True))  # five seeds
        return B.seedwise_zscore_blend(bag.unionByName(fixed.select(*bag.columns)), weights)
    raise ValueError(f"unknown task {task}")
