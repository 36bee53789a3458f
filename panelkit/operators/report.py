"""Report operators: reason texts, factor tables, status rules, filtered views, entity dossiers
(F25, F27, F35, F39, R1–R3, R8, P16–P18, J9, W8, W14, A24, A25).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.strata import stratum_sort_key
from panelkit.operators.ranking import dense_ranks
from panelkit.operators.topk import topk_flags

# Fixed values that must equal the reference: reason rules (column, message) in order, the default message, the
# short factor labels, the threshold and the direction labels.
REASON_RULES = (
    ("matem", "Baixo desempenho em Matemática"),
    ("portug", "Baixo desempenho em Português"),
    ("ieg", "Engajamento reduzido (IEG)"),
    ("ips", "Sinal psicossocial de atenção (IPS)"),
)
REASON_DEFAULT = "Padrão de risco global acima da referência da fase"
FACTOR_LABELS = (("matem", "Matemática"), ("portug", "Português"), ("ieg", "IEG"), ("ips", "IPS"))
RULE_LIMIT = 6.0
UP, DOWN = "↑ risco", "↓ risco"
ACTION_DRIFT = "Drift alto: manter monitoramento e preparar plano de retreino quando houver novos dados."
ACTION_AUC = "AUC OOT abaixo de 0.70: investigar mudança de dados/features."
ACTION_PRECISION = "Precision@K (Top-K) baixa: ajustar K ou revisar critério de alerta."
ACTION_DEFAULT = "Coerente com drift: manter uso e monitorar PSI + métricas OOT periodicamente."
WARNING_LIKE = ("critical", "high", "danger", "warning", "medium", "warn")


def reason_text(df: DataFrame) -> Column:
    """messages of the rules whose column is below 6 (in rule order, first 3), joined by ', '; the default
    sentence when none applies. Columns missing from the frame are skipped."""
    hits = [F.when(F.col(c) < RULE_LIMIT, F.lit(msg)) for c, msg in REASON_RULES if c in df.columns]
    if not hits:
        return F.lit(REASON_DEFAULT)
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.lit(REASON_DEFAULT)).otherwise(F.array_join(F.slice(found, 1, 3), ", "))


def factors_from_arrays(names: Column, values: Column) -> Column:
    """F35 (attribution form): first 5 (feature, impact, direction) structs from parallel name / value arrays."""
    zipped = F.slice(F.arrays_zip(names.alias("feature"), values.alias("impact")), 1, 5)
    return F.transform(zipped, lambda e: F.struct(
        e["feature"].alias("feature"), F.round(F.coalesce(e["impact"], F.lit(0.0)), 4).alias("impact"),
        F.when(F.coalesce(e["impact"], F.lit(0.0)) > 0, F.lit(UP)).otherwise(F.lit(DOWN)).alias("direction")))


def factors_from_rules(df: DataFrame) -> Column:
    """F35 (rule fallback): for each rule column below 6, (label, value, impact = 6 − value, '↑ risco'), first 5."""
    items = [F.when(F.col(c) < RULE_LIMIT, F.struct(F.lit(label).alias("feature"), F.col(c).cast("double").alias("value"),
                                                    (F.lit(RULE_LIMIT) - F.col(c)).alias("impact"),
                                                    F.lit(UP).alias("direction")))
             for c, label in FACTOR_LABELS if c in df.columns]
    return F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, 5)


def status_collapse(c: Column) -> Column:
    """warning-like labels → 'critical', anything else → 'ok'."""
    return F.when(F.lower(F.trim(c)).isin(*WARNING_LIKE), F.lit("critical")).otherwise(F.lit("ok"))


def gate(c: Column, ok: float, warn: float) -> Column:
    """F26 metric gates: ≥ ok → 'ok', ≥ warn → 'warning', else 'critical'; null → 'warning'."""
    return (F.when(c.isNull(), F.lit("warning")).when(c >= ok, F.lit("ok")).when(c >= warn, F.lit("warning"))
            .otherwise(F.lit("critical")))


# Fixed gate values (ok, warning) of the dashboard.
GATES = {"auc": (0.70, 0.65), "precision": (0.75, 0.65), "recall": (0.35, 0.25), "lift": (1.8, 1.3)}


def psi_status(c: Column) -> Column:
    return (F.when(c.isNull(), F.lit("ok")).when(c < 0.10, F.lit("ok")).when(c < 0.20, F.lit("warning"))
            .otherwise(F.lit("critical")))


def low_sample(n: Column, limit: int = 100) -> Column:
    """'low_sample' when fewer than ``limit`` rows, else null."""
    return F.when(n < limit, F.lit("low_sample"))


def monitoring_panel(metrics: DataFrame, k: int = 15) -> DataFrame:
    """R1 + R2 + R3 + F26 over a one-row metrics table with columns psi, auc, precision, recall, lift.

    R1: drift when psi ≥ 0.10; coherent when auc ≥ 0.70 and precision ≥ 0.65.
    R2: up to three recommended actions, default text otherwise.
    R3: suggest K = 20% when recall < 0.30."""
    psi, auc, prec, rec, lift = (F.col(c) for c in ("psi", "auc", "precision", "recall", "lift"))
    actions = F.filter(F.array(
        F.when(psi >= 0.20, F.lit(ACTION_DRIFT)), F.when(auc < 0.70, F.lit(ACTION_AUC)),
        F.when(prec < 0.65, F.lit(ACTION_PRECISION))), lambda x: x.isNotNull())
    suggestion = F.when(
        prec.isNotNull() & rec.isNotNull(),
        F.format_string("Com K=%d%%, Precision≈%.0f%% e Recall≈%.0f%%. ", F.lit(k), prec * 100, rec * 100))
    tail = F.when(rec < 0.30, F.lit("Para maior cobertura, considere K=20%.")).otherwise(F.lit("Bom equilíbrio."))
    return metrics.select(
        "*",
        F.when(psi >= 0.10, F.lit("Drift")).otherwise(F.lit("Estável")).alias("drift_axis"),
        F.when((auc >= 0.70) & (prec >= 0.65), F.lit("Coerente")).otherwise(F.lit("Não coerente")).alias("coherence_axis"),
        F.when(F.size(actions) == 0, F.array(F.lit(ACTION_DEFAULT))).otherwise(actions).alias("actions"),
        F.when(suggestion.isNotNull(), F.concat(suggestion, tail)).alias("k_suggestion"),
        psi_status(psi).alias("psi_status"),
        *[gate(F.col(m), *GATES[m]).alias(f"{m}_status") for m in ("auc", "precision", "recall", "lift")],
    )


def filtered_view(df: DataFrame, k_pct: float, period: int | None = None, strata: list | None = None,
                  groups: list | None = None, id_query: str | None = None, entity: str = "ra",
                  period_col: str = "ano_base", stratum: str = "fase", group: str = "turma",
                  score: str = "score") -> DataFrame:
    """Optional filters (period equality, strata / groups compared as strings, case-insensitive id substring)
    applied BEFORE the top-K, so K applies to the filtered population; then the dashboard top-K (W3b) and reasons."""
    out = df
    if period is not None:
        out = out.filter(F.col(period_col) == int(period))
    if strata:
        out = out.filter(F.col(stratum).cast("string").isin([str(s) for s in strata]))
    if groups:
        out = out.filter(F.col(group).cast("string").isin([str(g) for g in groups]))
    if id_query and id_query.strip():
        out = out.filter(F.lower(F.col(entity).cast("string")).contains(id_query.strip().lower()))
    out = topk_flags(out, k_pct, score, stratum, entity, "alerta", null_stratum="exclude", null_scores="never",
                     as_bool=True)
    return out.withColumn("motivos", reason_text(out))


def id_candidates(raw: Column) -> Column:
    """Candidate spellings of an id in order: as given (trimmed); without an 'RA-' / 'RA' prefix; with 'RA-'
    added when the value is digits (hyphens allowed). Duplicates removed, first occurrence kept."""
    s = F.trim(raw)
    up = F.upper(s)
    stripped = (F.when(up.startswith("RA-"), F.trim(F.substring(s, 4, 10_000)))
                .when(up.startswith("RA"), F.trim(F.regexp_replace(F.substring(s, 3, 10_000), r"^[- ]+", ""))))
    digits = F.when(s.rlike(r"^[0-9]+$") | F.regexp_replace(s, "-", "").rlike(r"^[0-9]+$"), F.concat(F.lit("RA-"), s))
    return F.array_distinct(F.filter(F.array(s, stripped, digits), lambda x: x.isNotNull()))


def match_ids(requests: DataFrame, request_col: str, table: DataFrame, entity: str) -> DataFrame:
    """Resolve each request id to the first candidate spelling that exists in ``table``.

    Candidates are exploded with their position, equi-joined to the distinct ids (a normal shuffle join, no
    per-request scan), and the lowest matching position wins."""
    cands = requests.select(request_col, F.posexplode(id_candidates(F.col(request_col))).alias("_pos", "_cand"))
    ids = table.select(F.trim(F.col(entity).cast("string")).alias("_cand")).distinct()
    hit = cands.join(ids, "_cand")
    best = hit.groupBy(request_col).agg(F.min(F.struct("_pos", "_cand")).alias("_b"))
    return requests.select(request_col).distinct().join(best, request_col, "left").select(
        request_col, F.col("_b._cand").alias("matched_id"))


def latest_record(df: DataFrame, entity: str, period: str) -> DataFrame:
    """The latest row of every entity (greatest period; the remaining columns break ties), as a
    hash aggregate — no sort of any entity's history."""
    rest = [c for c in df.columns if c not in (entity, period)]
    picked = df.groupBy(entity).agg(F.max(F.struct(period, *rest)).alias("_r"))
    return picked.select(entity, *[F.col("_r")[c].alias(c) for c in [period] + rest])


def trajectory(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Per entity, the (period, value) history in period order and the change since the previous period.

    Rows are first reduced to one per (entity, period) with a map-side-combined aggregate, so an entity's history is
    bounded by the number of periods even when an id is duplicated across a large share of the rows."""
    one = df.groupBy(entity, period).agg(F.min(F.col(value)).alias(value))
    hist = one.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(period, value))).alias("history"))
    w = Window.partitionBy(entity).orderBy(period)
    change = one.select(entity, period, value, (F.col(value) - F.lag(value).over(w)).alias("change"))
    return hist, change


def explain_entities(scored: DataFrame, entity: str = "ra", period: str = "ano_base",
                     factor_values: list[str] | None = None) -> DataFrame:
    """P17 in batch form: for every entity its latest scored row (W8) with the (feature, attribution, own value)
    triples of its top factors; entities without a row simply do not appear (the point lookup's 'not found')."""
    latest = latest_record(scored, entity, period)
    cols = factor_values or []
    own = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols])) \
        if cols else F.create_map().cast("map<string,double>")
    triples = F.transform(F.arrays_zip(F.col("top3_factors").alias("f"), F.col("top3_values").alias("v")),
                          lambda e: F.struct(e["f"].alias("feature"), e["v"].alias("shap_value"),
                                             F.try_element_at(own, e["f"]).alias("student_value")))
    return latest.select(entity, period, "score", *[c for c in ("alerta", "fase") if c in latest.columns],
                         triples.alias("top_factors"))


def filter_vocabularies(df: DataFrame, period: str = "ano_base", stratum: str = "fase",
                        group: str = "turma") -> DataFrame:
    """Distinct non-null periods, strata (ordered by the stratum sort key, then text) and groups as one long
    table (kind, value, ord), plus the default period (the maximum) flagged."""
    def kind(name: str, col: str, number: Column, text: Column) -> DataFrame:
        v = F.col("value")
        values = df.select(F.col(col).cast("string").alias("value")).where(v.isNotNull()).distinct()
        return values.select(F.lit(name).alias("kind"), "value", number.alias("_a"), text.alias("_b"))

    value, none = F.col("value"), F.lit(None)
    every = (kind("period", period, value.cast("bigint"), none.cast("string"))
             .unionByName(kind("stratum", stratum, stratum_sort_key(value).cast("bigint"), value))
             .unionByName(kind("group", group, none.cast("bigint"), value)))
    return dense_ranks(every, ["_a", "_b"], "ord", by="kind").select("kind", "value", "ord")


def dossiers(df: DataFrame, entity: str = "ra", period: str = "ano_base", value: str = "ieg", stratum: str = "fase",
             group: str = "turma", bins: int = 20) -> DataFrame:
    """One row an entity with its latest record, history, factors, reasons and place in its stratum, nested:
    ``latest`` (struct), ``history`` (array of period and value), ``factors`` (F35), ``motivos`` (F25) and ``place``
    (share of the stratum's rows in lower bins, and its rows).

    Rows are first reduced to one per (entity, period), combined inside each task, so an id that a third of all rows
    carry is one record a period before it moves. One exchange on the entity then brings its records together, and latest,
    history and factors are expressions on that one array. The strata's bins are joined by stratum (strata x bins numbers;
    Spark broadcasts them by their measured size)."""
    rest = [c for c in df.columns if c not in (entity, period)]
    ends = df.groupBy(stratum).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))

    def place(lo: Column, hi: Column, v: Column) -> Column:
        return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")

    binned = df.where(F.col(value).isNotNull()).select(stratum, value).join(ends, stratum)
    counts = binned.groupBy(stratum, place(F.col("_lo"), F.col("_hi"), F.col(value)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(stratum).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).groupBy(stratum).agg(
        F.sum("_n").alias("_rows"), F.map_from_entries(F.collect_list(F.struct("_bin", "_below"))).alias("_bins")).join(ends, stratum)
    table = table.select(F.col(stratum).alias("_stratum"), "_rows", "_bins", "_lo", "_hi")

    # equal (entity, period) rows: the least record, as the trajectory takes it
    one = df.groupBy(entity, period).agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("_r"))
    packed = one.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("_p"), "_r"))).alias("_all"))
    last = F.element_at("_all", -1)
    history = F.transform("_all", lambda e: F.struct(e["_p"].alias("period"), e["_r"][value].alias("value")))
    flat = packed.select(entity, history.alias("history"), last["_p"].alias(period), *[last["_r"][c].alias(c) for c in rest])
    joined = flat.join(table, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    bin_of = place(F.col("_lo"), F.col("_hi"), F.col(value))
    where = F.when(F.col(value).isNotNull(), F.struct((F.try_element_at("_bins", bin_of) / F.col("_rows")).alias("share_below"), F.col("_rows").alias("n_rows")))
    return joined.select(entity, F.struct(period, *rest).alias("latest"), "history", factors_from_rules(flat).alias("factors"),
                         reason_text(flat).alias("motivos"), where.alias("place"))


def stratum_histogram(df: DataFrame, stratum: str = "fase", score: str = "score", bins: int = 20) -> DataFrame:
    """Per stratum, ``bins`` equal-width bins over the stratum's own [min, max] (the max falls in the last
    bin); counts per (stratum, bin). Min / max come from one small aggregate joined back by stratum."""
    rng = df.groupBy(stratum).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    j = df.select(stratum, score).filter(F.col(score).isNotNull()).join(rng, stratum)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col(score) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    return j.groupBy(stratum, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
