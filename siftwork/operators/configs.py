"""Configuration encoding. Every step is a projection over the configuration's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.ids import content_id

SITE_MODULES = ("attn_out", "mlp_out", "block_residual")
# ---- fixed values: which named modules reach which site, and operator types
ATTENTION = ["q_proj", "k_proj", "v_proj", "o_proj", "qkv_proj", "attn", "attention"]
FEED_FORWARD = ["up_proj", "down_proj", "gate_proj", "mlp", "fc1", "fc2"]
OPERATOR_OF = {
    "lora": "additive_low_rank",
    "ia3": "multiplicative",
    "adapter": "additive_bottleneck",
    "prefix": "prefix",
    "bitfit": "bias_shift",
    "ptuning": "prefix",
}
OPERATOR_LABEL = {
    "additive_low_rank": "add. low-rank",
    "multiplicative": "multiplicative",
    "additive_bottleneck": "add. bottleneck",
    "prefix": "prefix",
    "bias_shift": "bias shift",
}
SCHEDULERS = ("cosine", "linear", "constant", "constant_with_warmup")
OPTIMIZERS = ("adamw", "sgd", "adafactor")
INITS = ("kaiming", "zero", "default")
RECIPE_DEFAULTS = {
    "optimizer": "adamw",
    "weight_decay": 0.0,
    "warmup_ratio": 0.03,
    "scheduler": "cosine",
    "batch_size": 16,
    "dropout": 0.0,
    "max_steps": 1000,
    "grad_clip": 1.0,
    "init_method": "default",
}
D_MODEL = 4096
FAMILY_SLOT = {"lora": 9, "ia3": 10, "adapter": 11, "prefix": 12, "ptuning": 12, "bitfit": 13}
# ---- end of fixed values


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def _d(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def with_layers(df: DataFrame) -> DataFrame:
    """target_layers from layer_range (all, or a third: low, mid, high) and the depth."""
    n = F.col("n_layers")
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    lo = F.when(F.col("layer_range") == "mid", third).when(F.col("layer_range") == "high", n - third).otherwise(0)
    hi = F.when(F.col("layer_range") == "low", third).when(F.col("layer_range") == "mid", 2 * third).otherwise(n)
    return df.withColumn("target_layers", F.sequence(lo, hi - 1))


def with_recipe(df: DataFrame) -> DataFrame:
    """Recipe columns the frame does not carry get the defaults."""
    for name, value in RECIPE_DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def config_id(extra: list[str] | None = None) -> Column:
    """Content id over the structural fields; rates enter as integer millionths."""
    return content_id(
        "family",
        F.concat_ws(",", "modules"),
        F.concat_ws(",", F.transform("target_layers", lambda x: x.cast("string"))),
        "rank",
        "alpha",
        "bottleneck",
        "prefix_len",
        F.round(F.col("lr") * 1e6).cast("bigint"),
        *(extra or []),
    )


def operator_type() -> Column:
    return _lookup(OPERATOR_OF, F.col("family"), "additive_low_rank")


def trainable_params(d_model: int = D_MODEL) -> Column:
    layers = F.size("target_layers").cast("bigint")
    mods = F.size("modules").cast("bigint")
    d = F.lit(d_model).cast("bigint")

    def size(c: str, default: int) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(default)).cast("bigint")

    fam = F.col("family")
    return (
        F.when(fam == "lora", layers * mods * 2 * size("rank", 8) * d)
        .when(fam == "adapter", layers * 2 * size("bottleneck", 64) * d)
        .when(fam == "prefix", size("prefix_len", 8) * layers * d)
        .when(fam == "ptuning", size("prefix_len", 8) * d)
        .otherwise(layers * mods * d)
    )


def site_layers(k: int = 8) -> Column:
    """k evenly spread layers, or all of a shallow backbone."""
    n = F.col("n_layers")
    spread = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (F.bround(i * n / F.lit(float(k))) - 1).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(spread)


def with_sites(df: DataFrame, k: int = 8) -> DataFrame:
    modules = F.array(*[F.lit(m) for m in SITE_MODULES])
    sites = F.flatten(
        F.transform(site_layers(k), lambda la: F.transform(modules, lambda m: F.struct(la.alias("layer"), m.alias("module"))))
    )
    return df.withColumn("sites", sites)


def with_site_weights(df: DataFrame, k: int = 8) -> DataFrame:
    """Raw and normalised site weights as arrays in site order."""
    if "target_layers" not in df.columns:
        df = with_layers(df)
    d = with_sites(df, k).withColumn("n_params", trainable_params())
    attn = F.arrays_overlap("modules", F.array(*[F.lit(x) for x in ATTENTION]))
    ff = F.arrays_overlap("modules", F.array(*[F.lit(x) for x in FEED_FORWARD]))
    d = d.withColumn("_at", attn).withColumn("_ff", ff).withColumn("_br", F.col("family") == "adapter")

    def touched(s: Column) -> Column:
        by_module = (
            F.when(s["module"] == "attn_out", F.col("_at"))
            .when(s["module"] == "mlp_out", F.col("_ff"))
            .otherwise(F.col("_br"))
        )
        return by_module & F.array_contains(F.col("target_layers"), s["layer"])

    d = d.withColumn("active", F.transform("sites", touched))
    d = d.withColumn("n_active", F.size(F.filter("active", lambda a: a)))
    cap = F.col("n_params") / F.greatest(F.lit(1), F.col("n_active"))
    d = d.withColumn("_w", F.tanh(F.log1p(cap / F.lit(float(D_MODEL)))))
    d = d.withColumn("site_weight", F.transform("active", lambda a: F.when(a, F.col("_w")).otherwise(0.0)))
    total = F.aggregate("site_weight", F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("_t", total).withColumn(
        "site_alpha", F.transform("site_weight", lambda x: F.when(F.col("_t") <= 1e-6, 0.0).otherwise(x / F.col("_t")))
    )
    return d.drop("_at", "_ff", "_br", "_w", "_t")


def site_indicators() -> Column:
    """[active, additive, multiplicative, prefix] per site, flattened."""
    op = operator_type()
    kinds = [op.isin("additive_low_rank", "additive_bottleneck"), op == "multiplicative", op == "prefix"]

    def four(a: Column) -> Column:
        on = F.when(a, 1.0).otherwise(0.0)
        return F.array(on, *[F.when(a & k, 1.0).otherwise(0.0) for k in kinds])

    return F.flatten(F.transform("active", four))


def capacity_vector(d_model: int = D_MODEL) -> Column:
    n = trainable_params(d_model).cast("double")
    slots = [
        F.log1p(n),
        n / 1e6,
        _d("rank") / 64,
        _d("alpha") / 64,
        _d("bottleneck") / 256,
        _d("prefix_len") / 64,
        F.log1p(n),
        F.log1p(n * 4 / (1024 * 1024)),
        F.when(F.col("family").isin("prefix", "ptuning"), 1.0).otherwise(0.0),
    ]
    slot = _lookup(FAMILY_SLOT, F.col("family"), 9)
    slots += [F.when(slot == i, 1.0).otherwise(0.0) for i in range(9, 14)]
    slots += [F.size("target_layers") / 32.0, F.size("modules") / 8.0]
    return F.array(*slots)


def recipe_vector() -> Column:
    def one_hot(col: str, vocab: tuple, width: int, default: int) -> list[Column]:
        at = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in vocab]), F.col(col)), F.lit(0)), F.lit(default + 1))
        return [F.when(at == i + 1, 1.0).otherwise(0.0) for i in range(width)]

    return F.array(
        F.log10(F.greatest(F.col("lr"), F.lit(1e-8))),
        _d("warmup_ratio"),
        _d("weight_decay"),
        *one_hot("scheduler", SCHEDULERS, 4, 0),
        *one_hot("optimizer", OPTIMIZERS, 3, 0),
        F.log2(F.greatest(F.col("batch_size"), F.lit(1)).cast("double")),
        _d("dropout"),
        F.log10(F.greatest(F.col("max_steps"), F.lit(1)).cast("double")),
        _d("grad_clip"),
        *one_hot("init_method", INITS, 2, 2),
    )


def encode(df: DataFrame, fingerprint: str | None = None, k: int = 8) -> DataFrame:
    """Add the condition vector z_p = site indicators + capacity + recipe (+ fingerprint)."""
    d = with_recipe(with_site_weights(df, k))
    parts = [site_indicators(), capacity_vector(), recipe_vector()]
    if fingerprint:
        parts.append(F.col(fingerprint).cast("array<double>"))
    return d.withColumn("z_p", F.concat(*parts))


def summary(df: DataFrame) -> DataFrame:
    """The configuration table: where it acts, with how much, and at what share of the backbone."""
    d = with_site_weights(df)
    n, n_layers = F.size("target_layers"), F.col("n_layers")
    third = F.greatest(F.lit(1), F.floor(n_layers / 3).cast("int"))
    first = F.element_at("target_layers", 1)

    def text(prefix: str) -> Column:
        return F.concat(F.lit(f"{prefix} ⅓ ("), n.cast("string"), F.lit(")"))

    layers = (
        F.when((n == 0) | (n == n_layers), F.concat(F.lit("all ("), n_layers.cast("string"), F.lit(")")))
        .when((n == third) & (first == 0), text("low"))
        .when((n == third) & (first == n_layers - third), text("high"))
        .when((n == third) & (first == third), text("mid"))
        .otherwise(F.concat(n.cast("string"), F.lit(" layers")))
    )
    capacity = (
        F.when(F.col("family") == "lora", F.concat(F.lit("r="), F.col("rank").cast("string")))
        .when(F.col("family") == "adapter", F.concat(F.lit("b="), F.col("bottleneck").cast("string")))
        .when(F.col("family").isin("prefix", "ptuning"), F.concat(F.lit("len="), F.col("prefix_len").cast("string")))
        .otherwise("—")
    )
    op = operator_type()
    return d.select(
        *[c for c in ("config", "name", "family", "model") if c in df.columns],
        F.concat_ws(",", "modules").alias("inserted_into"),
        layers.alias("layers"),
        _lookup(OPERATOR_LABEL, op, "").alias("operator"),
        capacity.alias("capacity"),
        F.col("n_params").alias("n_trainable"),
        (100.0 * F.col("n_params") / F.col("backbone_params")).alias("pct_backbone"),
        F.concat_ws("/", F.col("n_active").cast("string"), F.size("sites").cast("string")).alias("touched_sites"),
        "group",
    )


def structural_bucket(a: str = "a", b: str = "b") -> Column:
    """How far apart two configurations are: capacity only, placement, or family."""
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    same_place = (c(a, "modules_key") == c(b, "modules_key")) & (c(a, "layer_range") == c(b, "layer_range"))
    return (
        F.when(c(a, "family") != c(b, "family"), "cross-family")
        .when(same_place, "same-fam-capacity")
        .otherwise("same-fam-placement")
    )


def pairs(named: DataFrame) -> DataFrame:
    """Unordered pairs of distinct registry configurations (registry-sized, not pool-sized)."""
    return named.alias("a").join(named.alias("b"), F.col("a.name") < F.col("b.name"))


def name_distance(a: Column, b: Column) -> Column:
    """|log2 rank gap| + placement change + module change, parsed from configuration names."""

    def rank(x: Column) -> Column:
        digits = F.regexp_extract(x, r"r(\d+)", 1)
        return F.log2(F.greatest(F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(0.0)), F.lit(1.0)))

    def place(x: Column) -> Column:
        return F.when(x.contains("low"), "low").when(x.contains("high"), "high").otherwise("all")

    def mods(x: Column) -> Column:
        return F.when(x.contains("all"), "all").when(x.contains("qkvo"), "qkvo").otherwise("qv")

    return (
        F.abs(rank(a) - rank(b))
        + F.when(place(a) != place(b), 1.0).otherwise(0.0)
        + F.when(mods(a) != mods(b), 1.0).otherwise(0.0)
    )


def tier(name: Column, table: dict) -> Column:
    return _lookup(table, name, "?")


def action(tier_col: Column, has_labels: Column) -> Column:
    """What to do for a configuration of a support tier."""
    return (
        F.when(tier_col == "L0", "zero-shot")
        .when(tier_col == "L1", "calibrate")
        .when((tier_col == "L2") & has_labels, "calibrate")
        .when(tier_col == "L2", "per-target selector")
        .otherwise("in support")
    )
