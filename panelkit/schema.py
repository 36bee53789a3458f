"""PanelSchema: the column roles of a longitudinal panel, resolved once per job."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSchema:
    entity: str = "ra"
    period: str = "ano_base"
    stratum: str = "fase"
    group: str = "turma"
    state: str = "defasagem"
    target: str = "target"
    score: str = "score"
    alert: str = "alerta"
    exam_cols: tuple[str, ...] = ("matem", "portug", "ingles")
    measure_cols: tuple[str, ...] = ("ieg", "iaa", "ips", "ipp")
    start_col: str = "ano_ingresso"
    pair_label: str = "pair_label"
    extra: dict = field(default_factory=dict)

    @property
    def state_t(self) -> str:
        return f"{self.state}_t"

    @property
    def state_t1(self) -> str:
        return f"{self.state}_t1"


DEFAULT = PanelSchema()
