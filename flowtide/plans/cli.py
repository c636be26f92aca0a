"""Command line: profile, features, train, score, report, run, test, score-new, bands, search, docs.

train fits and stores the models, score applies them to the development windows, report (or bands, with other bands) makes all outputs
from what is stored; run does all three and the reserved period."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from ..operators.features import FEATURES, PAIR_FEATURES
from ..sources.contract import load_contract
from ..sources.files import footer_rows
from ..sources.flows import FIELDS
from ..sources.profile import profile_days, profile_flows
from .config import load_config
from ..sources.spool import discard_all
from .runs import finalize, load_bundle, open_context, run_experiment, score, score_development, search, train


def documents(contract: str | None = None) -> str:
    """Reference of features, fields and raw columns, generated from the registries and the contract."""
    lines = ["# Features", *(f"- `{f.name}`: {f.doc}; needs {', '.join(f.needs) or 'nothing'}" for f in FEATURES), *(f"- `{n}`: pair analysis" for n in PAIR_FEATURES), "# Fields", *(f"- `{f.name}` <- `{f.default}` ({f.kind}{', required' if f.required else ''})" for f in FIELDS)]
    return "\n".join([*lines, load_contract(contract).to_markdown()])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command."""
    p = argparse.ArgumentParser(prog="flowtide", description=__doc__)
    p.add_argument("command", choices=["profile", "features", "train", "score", "report", "run", "test", "score-new", "bands", "search", "docs"])
    p.add_argument("--config")
    p.add_argument("--bundle")
    p.add_argument("--inputs", nargs="*", default=[])
    p.add_argument("--history")
    p.add_argument("--bands", help="YAML with band settings")
    a = p.parse_args(args)
    if a.command == "docs":
        print(documents(load_config(a.config).contract if a.config else None))
        return 0
    cfg = load_config(a.config, {"bands": yaml.safe_load(Path(a.bands).read_text())} if a.bands else None)
    spark = spark or SparkSession.builder.appName("flowtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("profile", "features"):
        ctx = open_context(spark, cfg)
        if a.command == "profile":
            print(json.dumps({"footers": footer_rows(ctx.source.footers), "flows": profile_flows(ctx.source.flows).first().asDict(), "days": [r.asDict() for r in profile_days(ctx.source.flows).collect()]}, default=str))
        else:
            print(ctx.features)
    elif a.command == "run":
        out = run_experiment(spark, cfg)
        bundle = json.loads((out / "manifest.json").read_text())["bundle"]
        print(out)
        if cfg.split.test or (not cfg.split.train and cfg.split.fractions.get("test")):
            print(score(spark, cfg, load_bundle(Path(cfg.output) / "bundles" / bundle), cfg.inputs, "test"))
    elif a.command in ("train", "score", "report", "bands"):
        ctx = open_context(spark, cfg)
        print(train(ctx) if a.command == "train" else score_development(ctx) if a.command == "score" else finalize(spark, ctx))
    elif a.command == "search":
        print(json.dumps(search(spark, cfg), default=str))
    else:
        print(score(spark, cfg, load_bundle(a.bundle), a.inputs or cfg.inputs, "test" if a.command == "test" else "new", a.history))
    discard_all(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
