"""The flagship plan: hide votes, forecast them without a model, score the forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plenara.operators import forecast, matrix


def vote_floors(full: DataFrame, masked: int = 8, seed: str | None = None, train: DataFrame | None = None) -> DataFrame:
    """Scores of all comparators over `full` (session, p, s, vote), `masked` cells of each session hidden."""
    visible, hidden = matrix.mask(full, masked, seed)
    return forecast.scores(forecast.baselines(hidden, visible, train), hidden)


def snapshot_floors(snapshots: DataFrame, masked: int | None = 8, seed: str | None = None, train: DataFrame | None = None) -> DataFrame:
    """The same over nested snapshots; with `masked` None the file's own held-out cells are scored. `train` snapshots give the prior."""
    cells, own = matrix.cells(snapshots), matrix.held_out(snapshots)
    if masked is None:
        visible, hidden = cells, own
    else:
        visible, hidden = matrix.mask(matrix.known_votes(cells, own), masked, seed, first=own)
    known = None if train is None else matrix.cells(train).unionByName(matrix.held_out(train).select("session", "p", "s", "vote"))
    return forecast.scores(forecast.baselines(hidden, visible, known), hidden)
