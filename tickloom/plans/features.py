"""Feature planner: turns requested columns into select stages over chunked series.

Features are grouped by how many running recursions lie beneath them (their phase) and, inside a
phase, by depth. One phase is a handful of selects over the same chunk window, so it costs one
shuffle; between phases the recursions receive their carry from the chunk summaries. Columns not
requested are never built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.blocks import CHUNK_ROWS, Series, index_rows, own, spread
from tickloom.operators.fill import fill
from tickloom.operators.scan import (
    Scan, affine_levels, carry_table, local_value, product, safe_chunk_rows, with_carry,
)
from tickloom.session import materialise

VIEWS = ("history", "as_of", "causal", "raw")


@dataclass(frozen=True)
class Stage:
    """One Window node: first the expressions over it, then rows built on its results."""

    windows: tuple[I.Feature, ...]
    scans: tuple[Scan, ...]
    rows: tuple[tuple[I.Feature, ...], ...]


@dataclass(frozen=True)
class FeaturePlan:
    """Phases of stages; the scans of a phase get their carry when it ends."""

    outputs: tuple[str, ...]
    phases: tuple[tuple[Stage, ...], ...]
    back: int
    ahead: int

    def scans(self, phase: int) -> list[Scan]:
        return [s for stage in self.phases[phase] for s in stage.scans]

    def read_after(self, phase: int) -> set[str]:
        """Columns that later phases read or that are asked for."""
        later = {n for stages in self.phases[phase + 1:] for stage in stages
                 for f in (*stage.windows, *[f for rows in stage.rows for f in rows])
                 for n in f.needs}
        return later | {s.u for p in range(phase + 1, len(self.phases)) for s in self.scans(p)
                        } | {s.r for p in range(phase + 1, len(self.phases)) for s in self.scans(p)
                             if s.r} | set(self.outputs)

    @property
    def all_scans(self) -> list[Scan]:
        return [s for p in range(len(self.phases)) for s in self.scans(p)]


def plan_features(
    outputs: Sequence[str], registry: dict[str, I.Feature],
) -> FeaturePlan:
    """Order the features beneath ``outputs``.

    Each feature gets a phase (finished recursions beneath it) and a level (Window nodes beneath
    it within the phase).
    """
    given = {*I.BASE, "_i"}
    place: dict[str, tuple[int, int]] = {n: (0, 0) for n in given}   # (phase, level)
    computed: dict[str, tuple[int, int]] = {}                        # where a scan runs
    depth: dict[str, int] = {n: 0 for n in given}
    reach: dict[str, tuple[int, int]] = {n: (0, 0) for n in given}
    order: list[I.Feature] = []

    def visit(name: str) -> None:
        if name in place:
            return
        f = registry[name]
        for need in f.needs:
            visit(need)
        phase, level = max(place[n] for n in f.needs)
        back = f.back + max(reach[n][0] for n in f.needs)
        ahead = f.ahead + max(reach[n][1] for n in f.needs)
        if f.kind == "row":
            place[name] = (phase, level)
            depth[name] = 1 + max(depth[n] for n in f.needs if place[n] == (phase, level))
        else:
            computed[name] = (phase, level + 1)
            finished = (phase + 1, 0) if f.kind == "scan" else (phase, level + 1)
            place[name], depth[name] = finished, 0
            if phase and f.back > 1:
                raise ValueError(f"{name} looks back {f.back} rows over a running recursion")
        reach[name] = (back, ahead)
        order.append(f)

    for name in outputs:
        visit(name)
    spots = [place[f.name] for f in order] + list(computed.values())
    phases = []
    for p in range(max((x[0] for x in spots), default=0) + 1):
        stages = []
        for level in range(max((x[1] for x in spots if x[0] == p), default=0) + 1):
            here = (p, level)
            rows = [f for f in order if f.kind == "row" and place[f.name] == here]
            deepest = max((depth[f.name] for f in rows), default=0)
            stages.append(Stage(
                tuple(f for f in order if f.kind == "win" and computed[f.name] == here),
                tuple(Scan(f.name, f.needs[0], f.ratio, f.scans, *f.needs[1:]) for f in order
                      if f.kind == "scan" and computed[f.name] == here),
                tuple(tuple(f for f in rows if depth[f.name] == d)
                      for d in range(1, deepest + 1)),
            ))
        phases.append(tuple(stages))
    # One row more than the frames read: running recursions need the row before the chunk.
    back = max((r[0] for r in reach.values()), default=0)
    ahead = max((r[1] for r in reach.values()), default=0)
    running = any(f.kind == "scan" for f in order)
    return FeaturePlan(tuple(outputs), tuple(phases), back + running, ahead)


def shared_calls(windows: Sequence[I.Feature]) -> tuple[list[str], list[str]]:
    """Distinct window calls of a stage as columns, and the features over those columns."""
    names: dict[str, str] = {}

    def column(found: re.Match) -> str:
        return names.setdefault(found.group(1), f"_call_{len(names)}")

    texts = [f"{re.sub('«(.*?)»', column, f.sql)} AS {f.name}" for f in windows]
    return [f"{text} AS {name}" for text, name in names.items()], texts


def run_plan(
    series: Series, plan: FeaturePlan, origin: str | None = None, seed: DataFrame | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Own rows with base columns, position columns, ``extra`` and every requested output.

    What a phase found is written once, with the columns that later phases read; the carry of its
    recursions and the next phase both start from that table, so no window runs twice.
    """
    size = series.chunk_rows
    frame = spread(series, plan.back, plan.ahead, origin)
    always = {*I.BASE, "_i", "_c", "_j", *extra}
    for number, stages in enumerate(plan.phases):
        for stage in stages:
            affine = [s for s in stage.scans if s.kind == "affine"]
            plain = [s for s in stage.scans if s.kind != "affine"]
            running = [f"{local_value(s, size)} AS {s.name}" for s in plain]
            calls, texts = shared_calls(stage.windows)
            if calls or running:
                kept = [*frame.columns, *[s.name for s in plain]]
                frame = frame.selectExpr("*", *calls, *running).selectExpr(*kept, *texts)
            if affine:
                kept = [*frame.columns, *[c for s in affine for c in (s.name, product(s.name))]]
                for level in zip(*[affine_levels(s, size) for s in affine]):
                    frame = frame.selectExpr("*", *[text for texts in level for text in texts])
                frame = frame.select(*kept)
            for rows in stage.rows:
                frame = frame.selectExpr("*", *[f"{f.sql} AS {f.name}" for f in rows])
        scans = plan.scans(number)
        if scans:
            names = {s.name for s in scans} | {product(s.name) for s in scans if s.kind == "affine"}
            wanted = always | names | plan.read_after(number)
            near = materialise(
                frame.filter((F.col("_j") >= -1) & (F.col("_j") < size)).select(
                    *[x for x in frame.columns if x in wanted]), "phase")
            carry = carry_table(near, scans, size, seed)
            frame = with_carry(near, carry, scans, [x for x in near.columns if x not in names])
    keep = dict.fromkeys([*I.BASE, "_i", "_c", "_j", *extra, *plan.outputs])
    return frame.filter(own(size)).select(*keep)


def registry_for(
    view: str, families: Iterable[Sequence[I.Feature]] | None = None, gaps: bool = False,
) -> dict[str, I.Feature]:
    """Features by name, default periods or ``families``, with the view's lagging span."""
    if families is None:
        found = I.registry(gaps)
    else:
        found = {f.name: f for family in (I.shared(), *families) for f in family}
    if view == "as_of":
        lagging = I.lagging_as_known()
        found[lagging.name] = lagging
    return found


def feature_table(
    bars: DataFrame,
    columns: Sequence[str] | None = None,
    view: str = "history",
    families: Iterable[Sequence[I.Feature]] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    bar_seconds: int = 3600,
    gaps: bool = False,
) -> DataFrame:
    """Bars plus the requested indicator columns (all of them by default).

    ``view``: ``history`` fills gaps forward then backward and keeps the look-ahead lagging span;
    ``as_of`` gives every row the values it has when the history ends there; ``causal`` fills
    forward only and leaves the lagging span out; ``raw`` does not fill. ``families`` replaces the
    default periods. ``gaps`` says that prices may be missing: exponential means then renormalise
    after a gap and Wilder's range starts from the known ranges (more phases, so more passes).
    """
    if view not in VIEWS:
        raise ValueError(f"view must be one of {VIEWS}")
    wanted = list(columns) if columns is not None else list(I.COLUMNS)
    if view == "causal":
        wanted = [x for x in wanted if x != "ichimoku_lagging"]
    registry = registry_for(view, families, gaps)
    plan = plan_features(wanted, registry)
    scans = plan.all_scans
    size = safe_chunk_rows([s.ratio for s in scans], chunk_rows)
    series = index_rows(bars.select(*I.BASE), size, bar_seconds, reuse=bool(scans))
    frame = run_plan(series, plan)
    if view != "raw":
        gaps = [x for x in wanted if x not in I.BASE]
        frame = fill(frame, gaps, view == "history")
    return frame.select(*dict.fromkeys([*I.BASE, *wanted]))


# --- named entry points ----------------------------------------------------------------------

def rsi(bars: DataFrame, period: int = 14, bar_seconds: int = 3600) -> DataFrame:
    return feature_table(bars, ["rsi"], "raw", [I.rsi(period)], bar_seconds=bar_seconds)


def adx(bars: DataFrame, period: int = 14, bar_seconds: int = 3600) -> DataFrame:
    return feature_table(bars, ["adx"], "raw", [I.adx(period)], bar_seconds=bar_seconds)


def ichimoku(bars: DataFrame, conversion: int = 9, base: int = 26, span_b: int = 52,
             shift: int = 26, bar_seconds: int = 3600) -> DataFrame:
    lines = ["ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b",
             "ichimoku_lagging"]
    return feature_table(bars, lines, "raw", [I.ichimoku(conversion, base, span_b, shift)],
                         bar_seconds=bar_seconds)


def ema(bars: DataFrame, *spans: int, bar_seconds: int = 3600) -> DataFrame:
    return feature_table(bars, [f"ema_{s}" for s in spans], "raw", [I.ema(s) for s in spans],
                         bar_seconds=bar_seconds)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
         bar_seconds: int = 3600) -> DataFrame:
    outputs = ["macd", "macd_signal", "macd_histogram", "macd_histogram_slope",
               "macd_bullish_cross"]
    return feature_table(bars, outputs, "raw", [I.macd(fast, slow, signal)],
                         bar_seconds=bar_seconds)


def average_true_range(bars: DataFrame, period: int = 14,
                       bar_seconds: int = 3600) -> DataFrame:
    return feature_table(bars, ["true_range", "atr_sma", "atr"], "raw",
                         [I.average_true_range(period)], bar_seconds=bar_seconds)
