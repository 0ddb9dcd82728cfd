"""Commands: python -m augury.cli NAME ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

import augury
from augury.config import Settings, Workspace
from augury.sources import files


def _spark():
    from augury.session import session

    return session("augury-cli")


def cmd_version(_) -> int:
    print(augury.__version__)
    return 0


def cmd_status(a) -> int:
    from augury.operators.metrics import status_kpis
    from augury.operators.models import Champion
    from augury.sources.log import TradeStore

    spark, path = _spark(), f"{a.artifacts}/champion.json"
    if files.exists(spark, path):
        m = Champion.load(str(path)).manifest
        print(f"champion: {m['model_name']} ({m['plugin_family']}), published {m['published_at']}")
    else:
        print("warning: no champion")
    folder = f"{a.artifacts}/workspaces/{a.workspace}/paper_trades"
    if not files.exists(spark, folder):
        print("warning: no trades")
        return 0
    r = status_kpis(TradeStore(spark, folder).read()).first()
    print(f"trades {r.n_trades}, open {r.n_open}, settled {r.n_settled}, P&L {r.total_pnl:+.2f}, hit rate {r.hit_pct:.1f}%")
    return 0


def cmd_scan(a) -> int:
    from pyspark.sql import functions as F

    from augury.sources.listings import fetch_all, read_pages

    spark = _spark()
    if not files.exists(spark, a.pages):
        print(f"no page dump at {a.pages}")
        return 1
    found = fetch_all(read_pages(spark, a.pages), a.keyword, max_results=a.limit)
    for r in found.limit(50).select(F.substring(F.get_json_object("body", "$.id"), 1, 18).alias("id"), F.substring(F.get_json_object("body", "$.question"), 1, 60).alias("question")).collect():
        print(f"{r.id:<18}  {r.question}")
    return 0


def cmd_record(a) -> int:
    from augury.operators import trading
    from augury.operators.models import Champion
    from augury.sources.log import TradeStore
    from augury.sources.tables import read_signals_json

    spark, path = _spark(), f"{a.artifacts}/champion.json"
    if not files.exists(spark, path):
        print("no champion: nothing is recorded")
        return 1
    if not files.exists(spark, a.signals):
        print("no signals")
        return 0
    zones = spark.createDataFrame(list(json.loads(files.read_text(spark, a.timezones)).items()), "city_or_segment string, tz string") if a.timezones else None
    store = TradeStore(spark, f"{a.artifacts}/workspaces/{a.workspace}/paper_trades")
    signals = trading.min_edge(read_signals_json(spark, a.signals), a.min_edge)
    allowed = sorted(Champion.load(str(path)).allowed_segments())
    new = trading.record(signals, store.read(), datetime.now(UTC), ["market_id", "outcome_label"], allowed, zones, a.flat_stake).cache()
    store.append(new)
    print(f"recorded {new.count()} trades")
    return 0


def cmd_settle(a) -> int:
    from augury.operators import trading
    from augury.sources.log import TradeStore

    spark = _spark()
    store = TradeStore(spark, f"{a.artifacts}/workspaces/{a.workspace}/paper_trades")
    old = store.read()
    done = trading.settle(old, spark.read.parquet(a.specs), a.today or datetime.now(UTC).date().isoformat(), a.no_leg).cache()
    r = trading.settlement_summary(done).first()
    store.settle(done.filter("newly_settled"), datetime.now(UTC).isoformat())
    print(f"settled {r.settled}, pending {r.pending}, P&L {r.total_pnl:+.6f}")
    return 0


def cmd_backtest(a) -> int:
    from augury.operators import backtest, metrics
    from augury.operators.models import SparkForecaster
    from augury.sources.tables import read_panel

    try:
        backtest.check_stride(a.stride)
        panel = read_panel(_spark(), a.panel)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}")
        return 1
    p = metrics.panel_profile(panel).first()
    print(f"panel: {p.n_rows} rows, {p.n_dates} dates, {p.n_markets} markets")
    tiebreak = ["outcome_label", "market_price"]
    if a.model == "rates":
        result = backtest.walk_forward_rates(panel, a.stride, a.min_train_rows, tiebreak, a.flat_stake)
    else:
        result = backtest.walk_forward_model(panel, lambda: SparkForecaster(a.model), a.stride, a.min_train_rows, tiebreak, a.flat_stake)
    r = metrics.run_summary(result.trades, result.steps).first().asDict()
    if not r["total_trades"]:
        print("no trades")
        return 0
    print(json.dumps(r))
    if a.output:
        Path(a.output).write_text(json.dumps(r, indent=2))
    return 0


def cmd_promote(a) -> int:
    from augury.operators.models import Champion, SparkForecaster
    from augury.sources.tables import read_gate_json

    spark = _spark()
    if not files.exists(spark, a.model) or not files.exists(spark, a.gate):
        print("model or gate file is missing")
        return 1
    gate = read_gate_json(a.gate, spark)
    if gate.get("decision") != "GO":
        print("NO_GO: " + ", ".join(f"{r['segment']} {r['reason']}" for r in gate.get("segment_results", []) if not r["passes"]))
        return 1
    Champion.publish(a.artifacts, SparkForecaster.load(a.model), gate, a.plugin)
    print("published")
    return 0


def cmd_report(a) -> int:
    from augury.operators.report import write_report
    from augury.sources.tables import read_trades_json

    spark = _spark()
    if not files.exists(spark, a.trades):
        print(f"no trades at {a.trades}")
        return 1
    trades = read_trades_json(spark, a.trades)
    if trades.isEmpty():
        print("warning: no trades")
    print(write_report(trades, a.output, a.title, a.brier))
    return 0


def cmd_workspace(a) -> int:
    import os
    import subprocess

    if not a.command:
        print("usage: workspace NAME COMMAND ...")
        return 2
    w = Workspace.from_name(a.name).make()
    return subprocess.run(a.command, env=os.environ | w.environment()).returncode


def parser() -> argparse.ArgumentParser:
    s = Settings.read()
    p = argparse.ArgumentParser(prog="augury")
    sub = p.add_subparsers(required=True)

    def add(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kind, default in options:
            c.add_argument(flag, type=kind, default=default, **({"required": True} if default is ... else {}))
        return c

    where = (("--artifacts", str, s.artifacts_dir), ("--workspace", str, s.workspace))
    add("version", cmd_version)
    add("status", cmd_status, *where)
    add("scan-markets", cmd_scan, ("--pages", str, ...), ("--keyword", str, None), ("--limit", int, 100))
    add("record-trades", cmd_record, *where, ("--signals", str, ...), ("--min-edge", float, s.min_edge), ("--flat-stake", float, s.flat_stake), ("--timezones", str, None))
    add("settle-trades", cmd_settle, *where, ("--specs", str, ...), ("--today", str, None), ("--no-leg", str, "reference"))
    add("backtest", cmd_backtest, ("--panel", str, ...), ("--stride", int, 30), ("--min-train-rows", int, 20), ("--flat-stake", float, 1.0), ("--model", str, "gradient_boosting"), ("--output", str, None))
    add("promote-champion", cmd_promote, ("--artifacts", str, s.artifacts_dir), ("--model", str, ...), ("--gate", str, ...), ("--plugin", str, "weather_tmax"))
    add("report", cmd_report, ("--trades", str, ...), ("--output", str, "report.html"), ("--title", str, "Paper trades"), ("--brier", float, None))
    c = add("workspace", cmd_workspace)
    c.add_argument("name")
    c.add_argument("command", nargs=argparse.REMAINDER)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
