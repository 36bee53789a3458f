"""Star model over a panel: keyed dedup (W4), fact and dimension tables, the three views (J4), union of periods.

Dedup never sorts a whole key group: keep-first is ``min(struct(rest))`` and keep-latest is ``max(struct(order, rest))``
per key — hash aggregates with map-side partial aggregation, so a key repeated across a third of the rows is reduced
inside each map task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.pairs import dedup_first


def dedup_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W4 keep-last: the row with the greatest ``order`` columns per key (remaining columns break ties)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in order + rest])


def union_periods(frames: list[DataFrame]) -> DataFrame:
    """Stack period tables by column name; a column missing in a period becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def build_star(panel: DataFrame, entity: str, period: str, fact_cols: list[str], entity_cols: list[str],
               indicator_cols: list[str], process_cols: list[str], entity_order: list[str]) -> dict[str, DataFrame]:
    """Fact, indicators and process (entity, period): one keep-first over the whole row, then three projections of that
    row, so they always describe the same source line and share one shuffle; entity dimension keep-latest by
    ``entity_order``. Each column list is intersected with what exists."""
    have = set(panel.columns)

    def pick(cols):
        return [c for c in cols if c in have and c not in (entity, period)]

    keys = [entity, period]
    used = list(dict.fromkeys([*pick(fact_cols), *pick(indicator_cols), *pick(process_cols)]))
    kept = dedup_first(panel.select(*keys, *used), keys)
    ent = dedup_latest(panel.select(entity, *pick(entity_cols)), [entity], [c for c in entity_order if c in have])
    return {"line": kept, "fact": kept.select(*keys, *pick(fact_cols)), "entity": ent,
            "indicators": kept.select(*keys, *pick(indicator_cols)), "process": kept.select(*keys, *pick(process_cols))}


def views(star: dict[str, DataFrame], entity: str, period: str, ml_entity_fields: list[str],
          dash_process_fields: list[str], audit_fact_fields: list[str]) -> dict[str, DataFrame]:
    """vw_ml = fact with entity fields by id; vw_360 = fact with indicators (a name that the fact has gets the suffix
    _ind) and process fields; vw_audit = process with fact fields. Fact, indicators and process are projections of one
    kept line, so the last two views are projections as well and join nothing."""
    keys = [entity, period]
    ent, line = star["entity"], star["line"]
    own = {name: [c for c in star[name].columns if c not in keys] for name in ("fact", "indicators", "process")}
    ml = star["fact"].join(ent.select(entity, *[c for c in ml_entity_fields if c in ent.columns]), entity, "left")
    indicators = [F.col(c).alias(f"{c}_ind") if c in own["fact"] else F.col(c) for c in own["indicators"]]
    v360 = line.select(*keys, *own["fact"], *indicators, *[c for c in dash_process_fields if c in own["process"]])
    audit = line.select(*keys, *own["process"], *[c for c in audit_fact_fields if c in own["fact"]])
    return {"vw_ml": ml, "vw_360": v360, "vw_audit": audit}
