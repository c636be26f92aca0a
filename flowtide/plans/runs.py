"""Experiment, frozen bundle, scoring of a reserved period or new files, ledger, robustness and search."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, date, datetime, time, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import features as FT
from ..operators import models as M
from ..operators import pairs as P
from ..operators import periods as PE
from ..operators import ranking as R
from ..operators.chart_data import bucket
from ..operators.ordering import discrete_quantile
from ..sources.files import check_outside, repository
from ..sources.flows import FIELDS, Source, open_source
from ..sources.spool import spooled
from .config import Config, load_annotations
from .report import Subject, levels, write_report, write_run_report

BUNDLE_VERSION = 3


class RunError(ValueError):
    """The run can't go on."""


def digest(*parts: object) -> str:
    """A content address."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_json(path: Path, data: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=1, sort_keys=True, default=str))


def feature_table(spark: SparkSession, source: Source, names: Sequence[str], minutes: int, cache: Path, rebuild: bool = False) -> tuple[DataFrame, str]:
    """The features, from the cache where it has them; partitioned by day."""
    key = digest("features", source.fingerprint, list(names), minutes, sorted((n, m.source, m.conversion) for n, m in source.report.fields.items()))
    path = cache / f"features-{key}"
    made = FT.host_window_features(source.flows, minutes, names)
    if rebuild or not (path / "_SUCCESS").exists():
        made.write.mode("overwrite").partitionBy("flow_date").option("compression", "zstd").parquet(str(path))
    return spark.read.schema(made.schema).parquet(str(path)), key


@dataclass
class Context:
    """What all steps of an experiment share."""

    cfg: Config
    source: Source
    table: DataFrame
    features: list[str]
    periods: list[PE.Period]
    notes: list[PE.Annotation]
    warnings: list[str]
    id: str
    pairs: str | None = None
    quality: list[dict] = field(default_factory=list)

    def period(self, name: str) -> PE.Period | None:
        return next((p for p in self.periods if p.name == name), None)

    def where(self, name: str) -> Column:
        p = self.period(name)
        return p.where(F.col("window_start")) & p.where_date(F.col("flow_date")) if p else F.lit(False)

    def development(self) -> Column:
        test = self.period("test")
        return F.col("window_start") < F.lit(datetime.combine(test.start, time()).isoformat(" ") + "+00:00").cast("timestamp") if test else F.lit(True)

    def train(self, exclude_annotated: bool | None = None) -> Column:
        out = self.where("train")
        if self.cfg.exclude_annotated if exclude_annotated is None else exclude_annotated:
            out = out & (self.category() == "outside")
        return out

    def category(self) -> Column:
        return PE.annotation_category(F.col("window_start"), F.col("window_end"), self.notes, self.cfg.buffer_hours)


def resolve_split(cfg: Config, days: Sequence[date]) -> list[PE.Period]:
    """Explicit periods, or fractions of the days with data; train must have data."""
    s = cfg.split
    if not s.train:
        return PE.split_by_fractions(days, s.fractions)
    periods = PE.check_periods([PE.Period(n, *v) for n in ("train", "validation", "test") if (v := getattr(s, n))])
    if not any(periods[0].start <= d < periods[0].end for d in days):
        raise PE.SplitError("train has no data")
    return periods


def check_places(cfg: Config, inputs: Sequence[str], guard: str | None = None) -> None:
    """Keeps data and what is made of it out of the checkout that this package runs from (or out of ``guard``), before anything is
    created. ``allow_inside_repository`` is for made-up data: with input from elsewhere the output must still lie outside."""
    guard = guard or repository()
    if guard is None:
        return
    if not cfg.allow_inside_repository:
        check_outside([*inputs, cfg.output], guard, "path")
    elif not all(Path(p).resolve().is_relative_to(Path(guard).resolve()) for p in inputs):
        check_outside([cfg.output], guard, "output for input from elsewhere")


def open_context(spark: SparkSession, cfg: Config, rebuild: bool = False, guard: str | None = None) -> Context:
    """Open the input, build features, split, add pair features, screen."""
    check_places(cfg, cfg.inputs, guard)
    source = open_source(spark, cfg.inputs, cfg.mapping(), cfg.epoch_unit)
    names = FT.select_features(source.available_features(), [n for n in cfg.include or [] if n not in FT.PAIR_FEATURES] or None, [n for n in cfg.exclude if n not in FT.PAIR_FEATURES])
    table, key = feature_table(spark, source, names, cfg.window_minutes, Path(cfg.output) / "cache", rebuild)
    periods = resolve_split(cfg, [r[0] for r in table.select("flow_date").distinct().collect()])
    notes = load_annotations(cfg.annotations) if cfg.annotations else []
    ctx = Context(cfg, source, table, names, periods, notes, list(source.report.assumptions), "")
    if cfg.relationships.enabled:
        test = ctx.period("test")
        out = Path(cfg.output) / "cache" / f"pairs-{digest(key, asdict(cfg.rel_params()), [asdict(p) for p in periods])}"
        if rebuild or not (out / "history").exists():
            P.analyze(source.flows, cfg.rel_params(), str(out), end=datetime.combine(test.start, time()) if test else None)
        ctx.pairs = str(out)
        if cfg.relationships.include_model_features:
            ctx.table = P.extend_features(table, spark.read.parquet(str(out / "host_windows")))
            ctx.features = names + [n for n in FT.PAIR_FEATURES if n not in cfg.exclude and (cfg.include is None or n in cfg.include)]
    ctx.quality = [r.asDict() for r in FT.feature_quality(ctx.table, ctx.features, ctx.train()).collect()]
    for q in ctx.quality:
        if q["status"] != "ok":
            ctx.warnings.append(f"{q['feature']} is {q['status']} in training and isn't used")
    ctx.features = [q["feature"] for q in ctx.quality if q["status"] == "ok"]
    ctx.id = digest("experiment", key, ctx.features, [asdict(p) for p in periods], [m.model_dump() for m in cfg.models], cfg.exclude_annotated, [asdict(a) for a in notes], cfg.buffer_hours)
    return ctx


def specs(cfg: Config) -> list[tuple[M.ModelSpec, int | None]]:
    return [(M.ModelSpec(m.kind, m.label, m.scaler, m.settings, m.seed), m.max_rows) for m in cfg.models]


def train_models(ctx: Context, where: Column | None = None, chosen: list | None = None) -> list[M.FittedModel]:
    """Fit each model on its bounded training sample."""
    train = ctx.period("train")
    days = (train.end - train.start).days
    return [M.fit_model(ctx.table, ctx.features, ctx.train() if where is None else where, s, days, n) for s, n in chosen or specs(ctx.cfg)]


def calibrate(ctx_scores: DataFrame, ids: Sequence[str], where: Column, cfg: Config) -> tuple[dict[str, R.Cutoffs], dict[str, float]]:
    """Cutoffs and grids of all models from the reference period, and the quantile of each band."""
    row = ctx_scores.where(where).agg((F.count("*") / F.countDistinct("flow_date")).alias("w")).first()
    q = R.band_quantiles(cfg.bands.quantiles, cfg.bands.budgets, row["w"])
    return R.calibrate(R.reference_scores(ctx_scores, ids, where), ids, q), q


def write_outputs(out: Path, table: DataFrame, flows: DataFrame, ids: list[str], cutoffs: dict[str, R.Cutoffs], stats: DataFrame, hosts: DataFrame, features: list[str], period: Column, notes: list[PE.Annotation], cfg: Config) -> dict:
    """Scores, alerts with context and traces, daily and per-host summaries. table carries raw scores."""
    spark = table.sparkSession
    order, review = list(cfg.bands.quantiles), cfg.bands.review
    category = PE.annotation_category(F.col("window_start"), F.col("window_end"), notes, cfg.buffer_hours)
    s = R.scored_windows(table, ids, cutoffs).withColumns({"period": period, "annotation_category": category})
    s = FT.with_stats(s, stats).withColumn("beyond_train_range", FT.beyond_range(features)).drop(*stats.columns)
    s.write.mode("overwrite").option("compression", "zstd").parquet(str(out / "scores"))
    s = spark.read.parquet(str(out / "scores"))
    alerts = R.ranked_alerts(s, ids, order, review).drop("beyond_train_range")
    full = R.alert_context(alerts, stats, hosts, features)
    bucketed = FT.bucketed(FT.usable(flows), cfg.window_minutes).select("src_ip", "window_start", "flow_start", "source_file", "source_row_index")
    traces = R.alert_traces(alerts, bucketed, cfg.top_n_traces, cfg.trace_rows).drop("alert_rank")
    full.join(traces, ["src_ip", "window_start"], "left").orderBy("alert_rank").write.mode("overwrite").parquet(str(out / "alerts"))
    R.daily_summary(s, ids, order, day_category=PE.day_category(F.col("flow_date"), notes, cfg.buffer_hours)).write.mode("overwrite").parquet(str(out / "daily"))
    R.entity_summary(s, ids, review).write.mode("overwrite").parquet(str(out / "entities"))
    return {"windows": s.count(), "alerts": spark.read.parquet(str(out / "alerts")).count()}


def run_experiment(spark: SparkSession, cfg: Config, rebuild: bool = False, guard: str | None = None) -> Path:
    """Train, score development windows, calibrate, write outputs, diagnostics, bundle and report. The test period isn't scored."""
    ctx = open_context(spark, cfg, rebuild, guard)
    out = train(ctx)
    score_development(ctx)
    if cfg.robustness_seeds:
        write_json(out / "robustness.json", robustness(ctx, stored_models(out)))
    finalize(spark, ctx)
    return out


def experiment_dir(ctx: Context) -> Path:
    return Path(ctx.cfg.output) / "experiments" / ctx.id


def train(ctx: Context) -> Path:
    """Fit and store the models."""
    out, sums = experiment_dir(ctx), {}
    for m in train_models(ctx):
        data = m.to_bytes()
        (out / "models").mkdir(parents=True, exist_ok=True)
        (out / "models" / f"{m.spec.model_id}.npz").write_bytes(data)
        sums[m.spec.model_id] = hashlib.sha256(data).hexdigest()
    write_json(out / "models.json", {"order": list(sums), "sha256": sums})
    return out


def stored_models(out: Path) -> list[M.FittedModel]:
    """The models that :func:`train` stored."""
    if not (out / "models.json").exists():
        raise RunError(f"{out} holds no models: train first")
    meta = json.loads((out / "models.json").read_text())
    return [M.FittedModel.from_bytes((out / "models" / f"{n}.npz").read_bytes(), meta["sha256"][n]) for n in meta["order"]]


def score_development(ctx: Context) -> Path:
    """Raw scores of the stored models over the development windows."""
    out = experiment_dir(ctx)
    M.score_table(ctx.table.where(ctx.development()), stored_models(out)).write.mode("overwrite").parquet(str(out / "raw_scores"))
    return out


def finalize(spark: SparkSession, ctx: Context, cfg: Config | None = None) -> Path:
    """Everything after raw scores, from the stored models and scores: nothing is fitted. With other bands it makes a new bundle, and the
    manifest keeps a revision for each time."""
    cfg, out = cfg or ctx.cfg, experiment_dir(ctx)
    fitted = stored_models(out)
    if not (out / "raw_scores" / "_SUCCESS").exists():
        raise RunError(f"{out} holds no scores: score first")
    ids = [m.spec.model_id for m in fitted]
    raw = spark.read.parquet(str(out / "raw_scores"))
    reference = "validation" if ctx.period("validation") else "train"
    cutoffs, quantiles = calibrate(raw, ids, ctx.where(reference), cfg)
    stats = FT.training_stats(ctx.table, ctx.features, ctx.where("train"))
    hosts = FT.host_context(ctx.table, ctx.where("train"), [n for n in ("flows", "bytes_total", "uniq_dst_ip", "uniq_dst_port") if n in ctx.table.columns])
    bundle = save_bundle(ctx, cfg, fitted, cutoffs, quantiles, stats, hosts)
    stats, hosts = (spark.read.parquet(str(bundle / n)) for n in ("train_stats", "train_hosts"))
    counts = write_outputs(out, raw, ctx.source.flows, ids, cutoffs, stats, hosts, ctx.features, PE.period_label(ctx.periods, F.col("window_start")), ctx.notes, cfg)
    found = diagnose(spark.read.parquet(str(out / "scores")), cutoffs, ctx, cfg)
    write_json(out / "diagnostics.json", found)
    past = json.loads((out / "manifest.json").read_text())["revisions"] if (out / "manifest.json").exists() else []
    revision = {"at": datetime.now(UTC).isoformat(), "bands": cfg.bands.model_dump(), "reference": reference, "cutoffs": {m: c.thresholds for m, c in cutoffs.items()}, "bundle": bundle.name}
    manifest = {"experiment": ctx.id, "bundle": bundle.name, "features": ctx.features, "periods": [asdict(p) for p in ctx.periods], "models": ids, "warnings": ctx.warnings, "fingerprint": ctx.source.fingerprint, "reference": reference, "revisions": [*past, revision], "coverage": coverage(ctx, fitted), **counts}
    write_json(out / "manifest.json", manifest)
    refits = json.loads((out / "robustness.json").read_text()) if (out / "robustness.json").exists() else []
    subject = Subject(out, cutoffs, cfg.bands.review, ctx.notes, cfg.buffer_hours, ctx.periods, ctx.pairs, cfg.rel_params(), cfg.relationships.top_pairs, top_k=cfg.diagnostics.top_k_per_day)
    write_report(spark, subject, manifest, found, refits)
    return bundle


def coverage(ctx: Context, fitted: Sequence[M.FittedModel]) -> dict:
    """How fields were read, what was assumed, the quality of the features, and the rows that models were fitted on."""
    report = ctx.source.report
    return {
        "fields": [asdict(m) for m in report.fields.values()], "unmapped": report.unmapped, "assumptions": report.assumptions, "quality": ctx.quality,
        "exclude_annotated": ctx.cfg.exclude_annotated, "fits": [{"model": m.spec.model_id, "train_rows": m.n_train} for m in fitted],
    }


def diagnose(scores: DataFrame, cutoffs: dict[str, R.Cutoffs], ctx: Context, cfg: Config) -> dict:
    """All diagnostics of the development windows as rows."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    ids, d, review = list(cutoffs), cfg.diagnostics, cfg.bands.review
    focus = next(p for p in reversed(ctx.periods) if p.name != "test").name
    near = {h: PE.annotation_category(F.col("window_start"), F.col("window_end"), ctx.notes, h) != "outside" for h in sorted({*d.buffers, cfg.buffer_hours})}
    edges = D.training_edges(scores, ctx.features, F.col("period") == "train")
    at = bucket(scores.agg(F.countDistinct("flow_date")).first()[0])
    out: dict = {"distribution": rows(D.score_distribution(scores, ids)), "drift": rows(D.feature_drift(scores, edges, F.col("period") == "train", at)) if edges else []}
    for m in ids:
        out[m] = {
            "volume": rows(D.band_volume(scores, m)), "curve": rows(D.cutoff_curve(scores, m, levels(cutoffs[m], D.CURVE))), "concentration": rows(D.concentration(scores, m, d.top_k_per_day)),
            "overlap": rows(D.annotation_overlap(scores, m, F.col("annotation_category"), review, d.top_k_per_day)), "training": rows(D.training_concentration(scores, f"{m}_raw", 0.99, 10)),
            "buffers": rows(D.buffer_sensitivity(scores, m, near, review, d.top_k_per_day)) if ctx.notes else [],
            "categories": rows(D.top_categories(scores.where(F.col("period") == focus), f"{m}_raw", d.top_n, F.col("annotation_category"))),
        }
    for a, b in zip(ids, ids[1:], strict=False):
        out[f"{a} x {b}"] = {
            "period": focus, "top": d.disagreements, "agreement": rows(D.model_agreement(scores, a, b, d.top_n, d.top_k_per_day, review)),
            "disagreements": rows(D.disagreements(scores, a, b, focus, d.disagreements)),
        }
    return out


def robustness(ctx: Context, fitted: list[M.FittedModel]) -> list[dict]:
    """Refits with other seeds, the other treatment of annotated rows, and without each model's top training rows; compared on validation."""
    out, period, d = [], ctx.where("validation"), ctx.cfg.diagnostics
    tops = lambda t, raw: {r["cat"]: r["share"] for r in D.top_categories(t, raw, d.top_n, ctx.category()).collect()}
    for f in fitted:
        raw = f"{f.spec.model_id}_raw"
        base = spooled(M.score_table(ctx.table.where(ctx.development()), [f]), "robustness")
        cut = discrete_quantile(base.where(ctx.train()), raw, d.trim_quantile).first()["cut"]
        kept = base.where(ctx.train() & (F.col(raw) < F.lit(cut))).select("src_ip", "window_start")
        variants = [(f"seed {s}", ctx, M.ModelSpec(f.spec.kind, f.spec.label, f.spec.scaler, f.spec.settings, s), ctx.train()) for s in ctx.cfg.robustness_seeds]
        if ctx.notes:
            variants.append(("annotated rows", ctx, f.spec, ctx.train(not ctx.cfg.exclude_annotated)))
        for name, c, spec, where in [*variants, ("trimmed", None, f.spec, ctx.train())]:
            table = ctx.table.join(kept, ["src_ip", "window_start"], "left_semi") if c is None else ctx.table
            p = ctx.period("train")
            other = M.fit_model(table, ctx.features, where, spec, (p.end - p.start).days, f.n_train)
            again = spooled(M.score_table(ctx.table.where(period), [other]), "refit")
            row = D.rank_agreement(base.where(period), raw, again, raw, d.top_n).first()
            out.append({"model": f.spec.model_id, "variant": name, "train_rows": other.n_train, "categories": tops(base.where(period), raw), "variant_categories": tops(again, raw), **row.asDict()})
    return out


def search(spark: SparkSession, cfg: Config) -> list[dict]:
    """Each listed override of the models, fitted and compared on validation; nothing is chosen."""
    ctx = open_context(spark, cfg)
    base = train_models(ctx)
    out = []
    for change in cfg.search:
        for f in base:
            if change.get("kind", f.spec.kind) != f.spec.kind:
                continue
            spec = M.ModelSpec(f.spec.kind, f.spec.label, change.get("scaler", f.spec.scaler), {**f.spec.settings, **change.get("settings", {})}, change.get("seed", f.spec.seed))
            other = train_models(ctx, chosen=[(spec, None)])
            raw = f"{f.spec.model_id}_raw"
            rows = M.score_table(ctx.table.where(ctx.where("validation")), [f]), M.score_table(ctx.table.where(ctx.where("validation")), other)
            out.append({"model": f.spec.model_id, "change": change, **D.rank_agreement(rows[0], raw, rows[1], raw, cfg.diagnostics.top_n).first().asDict()})
    write_json(Path(cfg.output) / "search.json", out)
    return out


def save_bundle(ctx: Context, cfg: Config, fitted: list[M.FittedModel], cutoffs: dict[str, R.Cutoffs], quantiles: dict[str, float], stats: DataFrame, hosts: DataFrame) -> Path:
    """Freeze models, mapping, cutoffs, grids, training references and pair history."""
    rel = {"params": asdict(cfg.rel_params()), "include_model_features": cfg.relationships.include_model_features} if cfg.relationships.enabled else None
    bundle = Path(cfg.output) / "bundles" / digest(ctx.id, {m: c.thresholds for m, c in cutoffs.items()}, rel)
    bundle.mkdir(parents=True, exist_ok=True)
    sums = {}
    for m in fitted:
        data = m.to_bytes()
        (bundle / f"{m.spec.model_id}.npz").write_bytes(data)
        sums[m.spec.model_id] = hashlib.sha256(data).hexdigest()
    stats.write.mode("overwrite").parquet(str(bundle / "train_stats"))
    hosts.write.mode("overwrite").parquet(str(bundle / "train_hosts"))
    if ctx.pairs:
        P.copy_history(stats.sparkSession, f"{ctx.pairs}/history", str(bundle / "history"))
    meta = {
        "version": BUNDLE_VERSION, "id": bundle.name, "experiment": ctx.id, "models": sums, "features": ctx.features, "window_minutes": cfg.window_minutes, "field_map": cfg.mapping(), "epoch_unit": cfg.epoch_unit,
        "sources": {n: {"source": m.source, "conversion": m.conversion} for n in required_fields(ctx.features, rel) if (m := ctx.source.report.fields[n])}, "quantiles": quantiles, "cutoffs": {m: asdict(c) for m, c in cutoffs.items()}, "periods": [asdict(p) for p in ctx.periods], "fingerprint": ctx.source.fingerprint, "relationships": rel, "review": cfg.bands.review, "bands": list(cfg.bands.quantiles),
    }
    write_json(bundle / "bundle.json", meta)
    return bundle


@dataclass
class Bundle:
    """A frozen bundle that was read back."""

    path: Path
    meta: dict
    models: list[M.FittedModel]
    cutoffs: dict[str, R.Cutoffs]


def load_bundle(path: str | Path) -> Bundle:
    """Refuses other versions, missing parts, changed models and other inputs."""
    path = Path(path)
    if not (path / "bundle.json").exists():
        raise RunError(f"{path} is no bundle")
    meta = json.loads((path / "bundle.json").read_text())
    if meta["version"] != BUNDLE_VERSION:
        raise RunError("the bundle has another version")
    models = []
    for name, sha in meta["models"].items():
        if not (path / f"{name}.npz").exists():
            raise RunError(f"the bundle lacks {name}")
        m = M.FittedModel.from_bytes((path / f"{name}.npz").read_bytes(), sha)
        if m.features != meta["features"]:
            raise RunError(f"{name} has other inputs")
        models.append(m)
    if meta["relationships"] and not (path / "history" / "state").exists():
        raise RunError("the bundle lacks its pair history")
    return Bundle(path, meta, models, {m: R.Cutoffs(**c) for m, c in meta["cutoffs"].items()})


def history_dir(bundle: Bundle, history: str | None) -> str:
    """Where the pair history to continue lies: of a bundle or a run that is named, else the bundle's own."""
    if history is None:
        return str(bundle.path / "history")
    for place in (Path(history) / "pairs" / "history", Path(history) / "history", Path(history)):
        if (place / "state").exists():
            return str(place)
    raise RunError(f"{history} holds no pair history")


def required_fields(features: Sequence[str], rel: dict | None) -> list[str]:
    """The canonical fields that new data must have: keys of windows, inputs of the models, keys of pairs."""
    need = {"flow_start", "src_ip", *(n for f in features if f in FT.BY_NAME for n in FT.BY_NAME[f].needs)}
    if rel:
        need |= {"dst_ip"} | ({"dst_port"} if rel["params"]["group_by_port"] else set()) | ({"protocol"} if rel["params"]["group_by_protocol"] else set())
    return [f.name for f in FIELDS if f.name in need]


def check_compatible(bundle: Bundle, source: Source) -> list[str]:
    """The fields that the models need must come from the same source columns and be usable; a column that is converted otherwise than in
    training, as one of another type, is a warning."""
    found, wrong, warnings = source.report.fields, [], []
    for n, trained in bundle.meta["sources"].items():
        if found[n].status != "ok" or found[n].source != trained["source"]:
            wrong.append(f"{n} needs {trained['source']} ({trained['conversion']}), found {found[n].source} ({found[n].status} {found[n].note})")
        elif found[n].conversion != trained["conversion"]:
            warnings.append(f"{n} <- {found[n].source}: {found[n].conversion}, in training {trained['conversion']}")
    if wrong:
        raise RunError("these files don't fit the bundle: " + "; ".join(wrong))
    return warnings


def score(spark: SparkSession, cfg: Config, bundle: Bundle, inputs: Sequence[str], kind: str, history: str | None = None) -> Path:
    """Score a reserved period (``test``) or new files (``new``) with frozen models, cutoffs, references and pair settings. Nothing is
    fitted. Pair analysis continues the bundle's history, or that of the bundle or run that ``history`` names."""
    meta = bundle.meta
    check_places(cfg, inputs)
    source = open_source(spark, inputs, meta["field_map"], meta["epoch_unit"])
    warnings = check_compatible(bundle, source)
    base = [n for n in meta["features"] if n not in FT.PAIR_FEATURES]
    table, _ = feature_table(spark, source, sorted({*base, "flows"}, key=list(FT.BY_NAME).index), meta["window_minutes"], Path(cfg.output) / "cache")
    fixed = [PE.Period(p["name"], date.fromisoformat(p["start"]), date.fromisoformat(p["end"])) for p in meta["periods"]]
    if kind == "test":
        period = next((p for p in fixed if p.name == "test"), None)
        if period is None:
            raise RunError("the bundle has no test period")
        if source.fingerprint != meta["fingerprint"]:
            warnings.append("the input differs from the one that the bundle was developed on: this isn't the reserved period of the same data")
    else:
        row = table.agg(F.min("flow_date"), F.max("flow_date")).first()
        if row[0] is None:
            raise RunError("the new files hold no usable flows")
        period = PE.Period("new", row[0], row[1] + timedelta(days=1))
        if source.fingerprint == meta["fingerprint"]:
            warnings.append("these are the files that the models were trained on")
    warnings += [f"overlaps {p.name}: those windows fitted or calibrated the models" for p in fixed if p.name != "test" and p.start < period.end and period.start < p.end]
    rel = meta["relationships"]
    before = history_dir(bundle, history) if rel else None
    run_id = digest(meta["id"], source.fingerprint, kind, [period.start, period.end], before)
    out = Path(cfg.output) / "runs" / run_id
    table = table.where(period.where(F.col("window_start")) & period.where_date(F.col("flow_date")))
    if not table.limit(1).count():
        raise RunError(f"no host windows in {period.name}, {period.start} to {period.end}")
    analyzed = False
    if rel:
        params = P.RelParams(**rel["params"])
        old = P.load_history(spark, before, params)
        try:
            P.analyze(source.flows, params, str(out / "pairs"), datetime.combine(period.start, time()), datetime.combine(period.end, time()), old)
            analyzed = True
        except P.RelationshipError as e:
            if rel["include_model_features"]:  # the models need the summaries: no score from a history that isn't theirs
                raise
            warnings.append(f"pair analysis left out: {e}")
        if rel["include_model_features"]:
            table = P.extend_features(table, spark.read.parquet(str(out / "pairs" / "host_windows")))
    if missing := [n for n in meta["features"] if n not in table.columns]:
        raise RunError(f"inputs are missing: {missing}")
    raw = M.score_table(table, bundle.models)
    notes = load_annotations(cfg.annotations) if cfg.annotations else []
    stats, hosts = (spark.read.parquet(str(bundle.path / n)) for n in ("train_stats", "train_hosts"))
    ids = [m.spec.model_id for m in bundle.models]
    counts = write_outputs(out, raw, source.flows, ids, bundle.cutoffs, stats, hosts, meta["features"], F.lit(period.name), notes, cfg)
    info = {"run": run_id, "bundle": meta["id"], "kind": kind, "period": asdict(period), "warnings": warnings, "models": ids, "fingerprint": source.fingerprint, "files": len(source.files), **counts}
    if kind == "test":
        info["use"] = ledger(Path(cfg.output) / "ledger.json", period, source.fingerprint, meta["id"], run_id)
    write_json(out / "run.json", info)
    params = P.RelParams(**rel["params"]) if rel else None
    subject = Subject(out, bundle.cutoffs, meta["review"], notes, cfg.buffer_hours, [period], str(out / "pairs") if analyzed else None, params, cfg.relationships.top_pairs, top_k=cfg.diagnostics.top_k_per_day)
    write_run_report(spark, subject, info, meta)
    return out


def ledger(path: Path, period: PE.Period, fingerprint: str, bundle: str, run: str) -> str:
    """Append-only record of final tests: ``first`` use of a test period, ``repeat`` with the same bundle, or ``reused`` with another."""
    rows = json.loads(path.read_text()) if path.exists() else []
    same = [r for r in rows if r["fingerprint"] == fingerprint and r["start"] == str(period.start) and r["end"] == str(period.end)]
    use = "first" if not same else "repeat" if any(r["bundle"] == bundle for r in same) else "reused"
    write_json(path, [*rows, {"start": str(period.start), "end": str(period.end), "fingerprint": fingerprint, "bundle": bundle, "run": run, "use": use}])
    return use
