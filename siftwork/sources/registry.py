"""Fixed registries: tuning configurations, backbones, tasks and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
MODULES = {
    "qv": ["q_proj", "v_proj"],
    "qkvo": ["q_proj", "k_proj", "v_proj", "o_proj"],
    "mlp": ["up_proj", "down_proj"],
    "all_linear": ["q_proj", "k_proj", "v_proj", "o_proj", "up_proj", "down_proj", "gate_proj"],
    "ia3_attn": ["k_proj", "v_proj"],
    "ia3_attnffn": ["k_proj", "v_proj", "down_proj"],
    "adapter_sites": ["o_proj", "down_proj"],
}
# name, family, modules, group, layers, rank, alpha, bottleneck, prefix_len, lr
SPECS = [
    ("L-r8-qv", "lora", "qv", "seen", "all", 8, 16, None, None, 2e-4),
    ("L-r16-qkvo", "lora", "qkvo", "seen", "all", 16, 32, None, None, 2e-4),
    ("L-r8-mlp", "lora", "mlp", "seen", "all", 8, 16, None, None, 2e-4),
    ("IA3-attnmlp", "ia3", "ia3_attnffn", "seen", "all", None, None, None, None, 5e-4),
    ("AD-b64", "adapter", "adapter_sites", "seen", "all", None, None, 64, None, 3e-4),
    ("L-r4-qv", "lora", "qv", "unseen_config", "all", 4, 8, None, None, 2e-4),
    ("L-r32-qkvo", "lora", "qkvo", "unseen_config", "all", 32, 64, None, None, 2e-4),
    ("L-r64-all", "lora", "all_linear", "unseen_config", "all", 64, 128, None, None, 1e-4),
    ("L-r8-lowlayers", "lora", "qv", "unseen_config", "low", 8, 16, None, None, 2e-4),
    ("L-r8-highlayers", "lora", "qv", "unseen_config", "high", 8, 16, None, None, 2e-4),
    ("L-r16-hlr", "lora", "qkvo", "unseen_config", "all", 16, 32, None, None, 5e-4),
    ("AD-b16", "adapter", "adapter_sites", "unseen_config", "all", None, None, 16, None, 3e-4),
    ("AD-b256", "adapter", "adapter_sites", "unseen_config", "all", None, None, 256, None, 3e-4),
    ("IA3-attnonly", "ia3", "ia3_attn", "unseen_config", "all", None, None, None, None, 5e-4),
    ("PRE-l16", "prefix", "qkvo", "ood_family", "all", None, None, None, 16, 2e-4),
    ("PT-l32", "ptuning", "qkvo", "ood_family", "all", None, None, None, 32, 2e-4),
    ("BF", "bitfit", "qkvo", "ood_family", "all", None, None, None, None, 2e-4),
]
# backbone tag, depth, approximate parameters
MODELS = [
    ("llama2-7b", 32, 6.738e9),
    ("llama2-13b", 40, 13.02e9),
    ("qwen2.5-7b", 28, 7.62e9),
    ("qwen2.5-14b", 48, 14.77e9),
]
# task, capability, metric, main
TASKS = [
    ("gsm8k", "math", "exact_match", True),
    ("humaneval", "code", "pass@1", True),
    ("mmlu", "knowledge", "accuracy", True),
    ("tydiqa", "multilingual", "f1", True),
    ("math", "hard_math", "accuracy", False),
    ("mbpp", "code", "pass@1", False),
    ("alpacaeval", "instruction", "lc_winrate", False),
    ("safety", "safety", "refusal_acc", False),
]
TIERS = {
    "L-r32-qkvo": "L0",
    "AD-b16": "L0",
    "L-r64-all": "L1",
    "AD-b256": "L1",
    "L-r8-highlayers": "L1",
    "PRE-l16": "L2",
    "PT-l32": "L2",
    "BF": "L2",
}
BUDGETS = [0.05, 0.10, 0.30]
# ---- end of fixed values ----------------------------------------------------

SPEC_SCHEMA = (
    "spec_no bigint, name string, family string, modules array<string>, modules_key string, group string, "
    "layer_range string, rank int, alpha int, bottleneck int, prefix_len int, lr double"
)


def specs(spark: SparkSession, names: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Registry rows; unknown names are an error."""
    known = {s[0] for s in SPECS}
    unknown = sorted(set(names or []) - known)
    if unknown:
        raise KeyError(f"unknown configurations {unknown}; known: {sorted(known)}")
    rows = [
        (i, n, fam, MODULES[m], m, g, lay, rk, al, bo, pl, lr)
        for i, (n, fam, m, g, lay, rk, al, bo, pl, lr) in enumerate(SPECS)
        if (names is None or n in names) and (group is None or g == group)
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def models(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "model_no bigint, model string, n_layers int, backbone_params double")


def tasks(spark: SparkSession, main_only: bool = False) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TASKS) if t[3] or not main_only]
    return spark.createDataFrame(rows, "task_no bigint, task string, capability string, metric string, is_main boolean")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIERS.items()), "name string, tier string")


def with_model(spec_rows: DataFrame, model: str = "llama2-7b") -> DataFrame:
    depth = {m[0]: m[1] for m in MODELS}
    if model not in depth:
        raise KeyError(f"unknown model {model!r}; known: {sorted(depth)}")
    return spec_rows.withColumn("model", F.lit(model)).withColumn("n_layers", F.lit(depth[model]))
