"""The flagship question: what is in a drawing set, by component and by layer."""
from __future__ import annotations

from pyspark.sql import DataFrame

from sheetmetric.operators import calibrate, measure


class Takeoff:
    """Lazy plan of the quantity tables of a drawing set; nothing runs until a table is used.

    ``calibration``: scales that were worked out (and stored) before, for plans that read them several times.
    """

    def __init__(self, entities: DataFrame, sheets: DataFrame, calibration: DataFrame | None = None):
        self.entities = entities
        self.calibration = calibrate.scale_calibration(sheets, entities) if calibration is None else calibration
        factors = calibrate.factors(self.calibration)
        self.detail = measure.block_detail(entities)
        self.blocks = measure.block_counts(self.detail)
        self.lengths = measure.layer_length(entities, factors)
        self.areas = measure.layer_area(entities, factors)
        self.measures = measure.layer_measures(entities, factors)

    def summary(self) -> DataFrame:
        return measure.quantity_summary(self.blocks, self.lengths, self.areas)

    def totals(self) -> DataFrame:
        return measure.merge_quantities(self.detail, self.measures)

    def appendix(self) -> DataFrame:
        return measure.quantity_appendix(self.detail, self.lengths, self.areas)
