"""Markdown and standalone HTML reports with inline SVG, of an experiment and of a scoring run; all figures come from small aggregates."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chart_data as C
from ..operators import diagnostics as D
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators.periods import Annotation, Period, annotation_category, overlapping
from . import charts

NOTES = [
    "Scores and percentiles order windows; they are no probabilities.",
    "A window below all thresholds isn't thereby safe.",
    "Annotations are context, not labels; nothing here measures detection.",
    "Unusual is meant against the training period: a harmless change ranks high, and what training already holds may rank low.",
    "Models see a host and a window, so slow or sparse activity may rank low.",
    "Raw scores compare within one model only; percentiles and bands compare models.",
    "Settings that were changed after a look at test results make later test results too good.",
]
#: Quantiles in which scores are compared with the reference.
LEVELS = (0.5, 0.9, 0.99, 0.999)


@dataclass
class Subject:
    """What a report is about: its folder, cutoffs, annotations, periods and pair analysis."""

    out: Path
    cutoffs: dict[str, R.Cutoffs]
    review: Sequence[str] = R.REVIEW
    notes: list[Annotation] = field(default_factory=list)
    buffer_hours: float = 0
    periods: list[Period] = field(default_factory=list)
    pairs: str | None = None
    rel: P.RelParams | None = None
    top_pairs: int = 25
    top: int = 20
    top_k: int = 20

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(str(self.out / name))

    def backdrop(self) -> charts.Backdrop:
        """Annotations with their buffers behind them, and the starts of periods."""
        pad = timedelta(hours=self.buffer_hours)
        spans = [(a.start - pad, a.end + pad, 0.12) for a in self.notes] + [(a.start, a.end, 0.25) for a in self.notes]
        return charts.Backdrop(spans, [(p.name, datetime.combine(p.start, time())) for p in self.periods])

    def category(self) -> Column:
        return annotation_category(F.col("window_start"), F.col("window_end"), self.notes, self.buffer_hours)


def table(headers: list[str], rows: list[tuple]) -> str:
    """A Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def to_html(markdown: str, title: str) -> str:
    """Headings, tables, lists and raw figures of our own Markdown."""
    out, in_table = [], False
    for line in markdown.split("\n"):
        if line.startswith("|"):
            cells = [c.strip() for c in line.strip("|").split("|")]
            if set("".join(cells)) <= {"-"}:
                continue
            out.append(("" if in_table else "<table>") + "<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr>")
            in_table = True
            continue
        if in_table:
            out.append("</table>")
            in_table = False
        if line.startswith("#"):
            n = len(line) - len(line.lstrip("#"))
            out.append(f"<h{n}>{html.escape(line[n:].strip())}</h{n}>")
        elif line.startswith("<figure"):
            out.append(line)
        elif line.startswith("- "):
            out.append(f"<li>{html.escape(line[2:])}</li>")
        elif line:
            out.append(f"<p>{html.escape(line)}</p>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><body>{chr(10).join(out)}{'</table>' if in_table else ''}</body>"


def _rows(df: DataFrame, *cols: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*cols).collect()]


def _found(headers: Sequence[str], rows: Sequence[dict]) -> str:
    """A table of some keys of rows that were already collected."""
    return table(list(headers), [tuple(r.get(h) for h in headers) for r in rows])


def levels(c: R.Cutoffs, shares: Sequence[float]) -> dict[float, float]:
    """The least reference score that these shares of the reference don't exceed."""
    return {q: next(g for g, share in zip(c.grid, c.shares, strict=True) if share >= q) for q in shares}


def chart_section(s: Subject, scores: DataFrame, zooms: int = 3) -> list[str]:
    """Charts over the written scores: review and bands over time, zooms, cutoff curve, distributions, heat map, hexbin, pair trends."""
    models, behind = list(s.cutoffs), s.backdrop()
    at, hit = C.bucket(scores.agg(F.countDistinct("flow_date")).first()[0]), R.in_review(models, s.review)
    over = C.review_by_bucket(scores, hit, at).orderBy("bucket").collect()
    out = [charts.bars([(r["bucket"], float(r[c])) for r in over], title, behind) for c, title in (("windows", "windows over time"), ("review", "review windows over time"))]
    for m, c in s.cutoffs.items():
        out.append(charts.stacked([(r["bucket"], r["band"], float(r["windows"])) for r in C.bands_by_bucket(scores, m, at).where(F.col("band") != R.BELOW).orderBy("bucket", "band").collect()], f"{m}: bands over time", behind))
        out.append(charts.lines([(r["period"], r["quantile"], float(r["per_day"])) for r in D.cutoff_curve(scores, m, levels(c, D.CURVE)).collect()], f"{m}: windows a day at or above each reference quantile"))
        lo, hi = scores.agg(F.min(f"{m}_raw"), F.max(f"{m}_raw")).first()
        if lo is not None:
            out.append(charts.lines([(r["period"], float(r["bin"]), float(r["windows"])) for r in D.score_histogram(scores, f"{m}_raw", lo, hi).collect()], f"{m}: scores from {lo:.4g} to {hi:.4g}"))
        for centre in C.zoom_centres(scores, m, zooms, timedelta(days=1)):
            out.append(charts.bars([(r["bucket"], float(r["review"])) for r in C.zoom(scores, hit, centre, timedelta(hours=12)).orderBy("bucket").collect()], f"{m}: review windows around {centre}", behind))
    out.append(charts.heatmap([(r[0], r[1], r[2]) for r in C.host_heatmap(scores, models, hit, at, 30).orderBy("src_ip", "bucket").collect()], "highest percentile by host"))
    for a, b in zip(models, models[1:], strict=False):
        out.append(charts.hexagons([tuple(map(float, r)) for r in C.hexbin(scores, a, b, s.cutoffs[a].n).orderBy("x", "y").collect()], f"rarity of {a} and {b}"))
    if s.pairs:
        signals = scores.sparkSession.read.parquet(f"{s.pairs}/pair_windows")
        rows = signals.groupBy(at.alias("bucket"), "novelty_status").agg(F.count("*").alias("n")).orderBy("bucket", "novelty_status").collect()
        out.append(charts.stacked([(r[0], r[1], float(r[2])) for r in rows], "pair windows by novelty", behind))
    return out


def totals(scores: DataFrame) -> list[str]:
    """Windows, hosts and flows, and from when to when."""
    r = scores.agg(F.count("*"), F.countDistinct("src_ip"), F.sum("flows"), F.min("window_start"), F.max("window_end")).first()
    return [f"- {r[0]} host windows of {r[1]} hosts with {r[2]} flows, from {r[3]} to {r[4]}"]


def candidate_section(s: Subject, spark: SparkSession) -> list[str]:
    """The highest ranked windows, what lies beyond training, and the hosts with most review windows."""
    models, alerts, entities = list(s.cutoffs), s.read(spark, "alerts"), s.read(spark, "entities")
    cols = ["alert_rank", "src_ip", "window_start", "period", "annotation_category", "review_band", "max_pct", "top_deviations", "beyond_train_range", "entity_seen_in_train", "trace_flow_count"]
    cols = [c for c in cols if c in alerts.columns]
    n, low = R.beyond_range_counts(s.read(spark, "scores"), models, s.review).first()
    hosts = ["src_ip", "windows", "train_windows", "flows", *[f"{m}_{c}" for m in models for c in ("review", "review_inside", "max_pct")]]
    most = sum((F.col(f"{m}_review") for m in models), F.lit(0))
    return [
        "## Candidates", table(cols, _rows(alerts.where(F.col("alert_rank") <= s.top).orderBy("alert_rank"), *cols)),
        f"Outside training, {n} windows have an input beyond its training range; {low} of them are in no review band. A model can't tell how far beyond they are.",
        "## Hosts", table(hosts, _rows(entities.orderBy(most.desc(), "src_ip").limit(s.top), *hosts)),
    ]


def comparison_section(found: dict) -> list[str]:
    """How far models agree, and where they don't."""
    out = []
    for pair, d in ((k, v) for k, v in found.items() if " x " in k):
        a, b = pair.split(" x ")
        out += [f"## {a} and {b}", _found(["period", "spearman", "top_jaccard", "daily_overlap", "both_review", "only_a", "only_b"], d["agreement"])]
        out += [f"Windows of {d['period']} in one model's top {d['top']} only:", _found(["src_ip", "window_start", f"{a}_raw", f"{b}_raw", "rank_a", "rank_b"], d["disagreements"])]
    return out


def annotation_section(s: Subject, found: dict[str, dict]) -> list[str]:
    """Where review windows and daily tops lie against the annotations; found has the overlap of each model, and maybe its buffers."""
    if not s.notes:
        return ["## Annotations", "There are none."]
    touched = lambda a: ", ".join(p.name for p in s.periods if overlapping([a], datetime.combine(p.start, time()), datetime.combine(p.end, time()))) or "none"
    rows = [(a.name, a.start, a.end, a.source, a.confidence, a.notes, touched(a)) for a in s.notes]
    out = ["## Annotations", table(["name", "start", "end", "source", "confidence", "notes", "periods"], rows), f"Shares of windows by category (buffer {s.buffer_hours:g} h). A ratio above 1 says that they coincide, not that they were detected."]
    for m, d in found.items():
        out += [f"### {m}", _found(["period", "cat", "base", "base_share", "review_share", "review_ratio", "top_share", "top_ratio"], d["overlap"])]
        if d.get("buffers"):
            out += ["Inside or near an annotation, by width of the buffer:", _found(["buffer_hours", "period", "base_share", "review_share", "review_ratio", "top_share", "top_ratio"], sorted(d["buffers"], key=lambda r: (r["period"], r["buffer_hours"])))]
    return out


def robustness_section(models: Sequence[str], found: dict, refits: list[dict]) -> list[str]:
    """Refits, hosts that lead in training or crowd the daily tops, and drift of the inputs."""
    out = ["## Robustness and drift"]
    shares = lambda c: " / ".join(f"{c.get(k, 0.0):.2f}" for k in ("inside", "buffer", "outside"))
    if refits:
        rows = [(r["model"], r["variant"], r["train_rows"], r["spearman"], r["top_jaccard"], shares(r["categories"]), shares(r["variant_categories"])) for r in refits]
        out += ["Each model refitted otherwise and compared on the validation period; categories of its top windows are inside / buffer / outside.", table(["model", "variant", "training rows", "spearman", "top jaccard", "categories", "of the refit"], rows)]
    for m in models:
        out += [f"### {m}", "Hosts in the highest training scores:", _found(["src_ip", "windows", "share"], found[m]["training"][:5])]
        out += ["Hosts in the daily tops:", _found(["period", "total", "hosts", "top_share", "most_frequent_host", "most_frequent_count"], found[m]["concentration"])]
    if found["drift"]:
        place = {b: float(i) for i, b in enumerate(sorted({r["bucket"] for r in found["drift"]}))}
        out.append(charts.lines([(r["feature"], place[r["bucket"]], r["psi"]) for r in found["drift"]], "stability index of features over time"))
    return out


def coverage_section(coverage: dict) -> list[str]:
    """How fields are read, what was assumed, and which features could be used."""
    return [
        "## Coverage", _found(["name", "source", "type", "status", "conversion", "files", "note"], coverage["fields"]), f"{len(coverage['unmapped'])} source columns are not mapped and never read.",
        *(f"- {a}" for a in coverage["assumptions"]), "", _found(["feature", "rows", "non_null", "train_finite", "status"], coverage["quality"]),
        "", f"Training {'leaves out' if coverage['exclude_annotated'] else 'includes'} annotated windows.", _found(["model", "train_rows"], coverage["fits"]),
    ]


def shift_section(s: Subject, scores: DataFrame, quantiles: dict[str, float]) -> list[str]:
    """Scores and bands of a run against the reference that calibrated them."""
    found = {r["model"]: r for r in D.score_distribution(scores, list(s.cutoffs)).collect()}
    rows = []
    for m, c in s.cutoffs.items():
        rows += [(m, "reference", *levels(c, LEVELS).values()), (m, "this run", *(found[m][f"q{q}"] for q in ("50", "90", "99", "999")))]
    counts = scores.agg(F.count("*").alias("n"), F.countDistinct("flow_date").alias("days"), *[F.count_if(F.col(f"{m}_band") == b).alias(f"{m} {b}") for m in s.cutoffs for b in s.cutoffs[m].thresholds]).first()
    bands = []
    for m, c in s.cutoffs.items():
        above = 0
        for b, cut in c.thresholds.items():
            n = counts[f"{m} {b}"]
            above += n
            bands.append((m, b, cut, n, n / counts["days"], above / counts["n"], 1 - quantiles[b]))
    return [
        "## Scores against the reference", table(["model", "scores", *(f"q{q:g}" for q in LEVELS)], rows), "Higher quantiles than the reference's say that more looks unusual than at calibration, so bands fill up.",
        "## Bands", table(["model", "band", "from score", "windows", "a day", "share at or above", "expected"], bands),
    ]


def pair_section(spark: SparkSession, pairs: str, p: P.RelParams, n: int) -> list[str]:
    """Status counts, the largest new pairs and changes, and the hosts with most of them."""
    signals, evidence = (spark.read.parquet(f"{pairs}/{x}") for x in ("pair_windows", "evidence"))
    counts, hosts = P.status_counts(signals).orderBy("signal", "status"), P.top_hosts(signals)
    new = [*p.pair_cols, "window_start", "novelty_status", "flows", "bytes", "last_seen_before", "reason"]
    changed = [*p.pair_cols, "window_start", "change_status", "flows", "baseline_flows_median", "baseline_support", "log2_change", "reason"]
    return [
        "## Pairs", table(counts.columns, _rows(counts, *counts.columns)), "### New and recently unseen", table(new, _rows(P.top_new_pairs(evidence, p, n), *new)),
        "### Largest changes", table(changed, _rows(P.top_changes(evidence, p, n), *changed)), "### Hosts with most new pairs", table(hosts.columns, _rows(hosts, *hosts.columns)),
    ]


def _write(out: Path, title: str, parts: list[str]) -> None:
    text = "\n".join([f"# {title}", *parts, "## How to read this", *(f"- {n}" for n in NOTES)])
    (out / "report.md").write_text("\n".join(p for p in text.split("\n") if not p.startswith("<figure")))
    (out / "report.html").write_text(to_html(text, title))


def _facts(facts: dict) -> list[str]:
    return [f"- {k}: {v}" for k, v in facts.items() if not isinstance(v, list | dict)]


def write_report(spark: SparkSession, s: Subject, manifest: dict, found: dict, refits: list[dict]) -> None:
    """report.md and report.html of an experiment; found holds its diagnostics."""
    scores, daily, models = s.read(spark, "scores"), s.read(spark, "daily").orderBy("flow_date"), list(s.cutoffs)
    seen = {r["period"]: r for r in scores.groupBy("period").agg(F.count("*").alias("windows"), F.countDistinct("flow_date").alias("days"), F.countDistinct("src_ip").alias("hosts")).collect()}
    rows = [(p.name, p.start, p.end, *((seen[p.name][c] for c in ("windows", "days", "hosts")) if p.name in seen else ("reserved" if p.name == "test" else 0, None, None))) for p in s.periods]
    if rest := seen.get("unassigned"):
        rows.append(("unassigned", None, None, rest["windows"], rest["days"], rest["hosts"]))
    parts = [*_facts(manifest), *totals(scores), "", table(["period", "start", "end", "windows", "days", "hosts"], rows), "## Overview", *chart_section(s, scores)]
    parts += ["## Cutoffs", table(["model", "band", "score"], [(m, b, v) for m, c in s.cutoffs.items() for b, v in c.thresholds.items()])]
    parts += ["## Days", table(daily.columns, _rows(daily.limit(400), *daily.columns)), *candidate_section(s, spark), *comparison_section(found)]
    parts += [*annotation_section(s, {m: found[m] for m in models}), *robustness_section(models, found, refits)]
    if s.pairs and s.rel:
        parts += pair_section(spark, s.pairs, s.rel, s.top_pairs)
    parts += [*coverage_section(manifest["coverage"]), "## Warnings", *(f"- {w}" for w in manifest["warnings"])]
    _write(s.out, "Unusual flow activity: development", parts)


def write_run_report(spark: SparkSession, s: Subject, info: dict, bundle: dict) -> None:
    """report.md and report.html of a scoring run with a frozen bundle, whose description ``bundle`` is."""
    scores = s.read(spark, "scores")
    title = "reserved test period" if info["kind"] == "test" else "new data"
    use = {"first": "This is the first test of the period.", "repeat": "The same bundle was tested on this period before.", "reused": "Another bundle was tested on this period before: it isn't untouched any more."}.get(info.get("use"), "There are no labels: this ranks windows against the training period.")
    parts = [use, *_facts(info), *totals(scores), *(f"- {p['name']}: {p['start']} to {p['end']}" for p in bundle["periods"]), f"- inputs, in this order: {', '.join(bundle['features'])}", "", "Nothing was fitted or calibrated on these data."]
    parts += ["## Warnings", *([f"- {w}" for w in info["warnings"]] or ["- none"]), "## Overview", *chart_section(s, scores), *shift_section(s, scores, bundle["quantiles"])]
    category = s.category()
    overlap = {m: {"overlap": [r.asDict() for r in D.annotation_overlap(scores, m, category, s.review, s.top_k).collect()]} for m in s.cutoffs} if s.notes else {}
    parts += [*annotation_section(s, overlap), *candidate_section(s, spark)]
    if s.pairs and s.rel:
        parts += pair_section(spark, s.pairs, s.rel, s.top_pairs)
    parts += ["## Traces", *(f"- {m}: SHA-256 {h}" for m, h in bundle["models"].items()), f"- input: {info['fingerprint']}", "- alerts name the files and rows of their flows; scores, days and hosts lie beside this report"]
    _write(s.out, f"Unusual flow activity: {title}", parts)
