"""panelkit — Spark-native analytics for longitudinal panels.

Tables observe the same entities once per period. The package standardises drifting period tables, pairs each period with
the next, builds group-relative features from statistics fitted on past periods, selects stratified top-K% alert lists,
evaluates them (recall / precision / lift / AUC) and monitors score drift. Every operator is DataFrame code.
"""

from panelkit.schema import PanelSchema

__all__ = ["PanelSchema"]
