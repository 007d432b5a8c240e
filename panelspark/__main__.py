"""`python -m panelspark`: queries and fits, panels (assemble) and models (analysis) by configuration."""

from __future__ import annotations

import argparse

from panelspark.session import build_session


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="panelspark")
    domains = top.add_subparsers(dest="domain", required=True)
    domains.add_parser("queries", help="list the named queries")
    run = domains.add_parser("run", help="run a named query over a folder of tables")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("out", nargs="?")
    fit = domains.add_parser("fit", help="fit a formula over a parquet table")
    fit.add_argument("table")
    fit.add_argument("formula")
    fit.add_argument("where", nargs="?")
    fit.add_argument("--out")
    panel = domains.add_parser("assemble", help="make, update or demean a panel").add_subparsers(dest="verb", required=True)
    for verb in ("create", "update", "demean"):
        p = panel.add_parser(verb)
        p.add_argument("--config", required=True)
        p.add_argument("--source", required=True, help="the panel's name in the configuration")
        if verb != "demean":
            p.add_argument("--datasource", required=verb == "update", action="append" if verb == "create" else "store", help="one of its sources")
    models = domains.add_parser("analysis", help="fit models of a sheet, print and clean their results").add_subparsers(dest="verb", required=True)
    for verb in ("run", "tables", "summary", "cleanup", "relabel"):
        p = models.add_parser(verb)
        p.add_argument("--config", required=True)
        if verb in ("run", "tables"):
            p.add_argument("--model", action="append", help="only this one; may come again")
        if verb == "run":
            p.add_argument("--again", action="store_true", help="also models that have results")
        if verb == "tables":
            p.add_argument("--formats", nargs="+", default=["text"])
        if verb in ("cleanup", "relabel"):
            p.add_argument("--dry-run", action="store_true")
    return top


def main(words: list[str] | None = None) -> None:
    args = _parser().parse_args(words)
    from panelspark.queries import QUERIES

    if args.domain == "queries":
        print("\n".join(QUERIES))
        return
    spark = build_session()
    if args.domain == "run":
        df = QUERIES[args.name](spark, args.sf_dir)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, False)
    elif args.domain == "fit":
        _fit(spark, args)
    else:
        (_assemble if args.domain == "assemble" else _analysis)(spark, args)


def _fit(spark, args) -> None:
    from panelspark.plans import formula
    from panelspark.sources.sinks import write_result

    got = formula.fit(spark.read.parquet(args.table), args.formula, args.where)
    for row in got.rows():
        print("%-24s %14.6f (%.6f)  t=%.3f p=%.4f" % row)
    if args.out:
        write_result(spark, got, args.out, formula=args.formula, where=args.where)


def _assemble(spark, args) -> None:
    from panelspark.plans import jobs
    from panelspark.sources.readers import config

    own = config(args.config)["assemble"][args.source]
    if args.verb == "create":
        out = jobs.create_panel(spark, own, args.datasource)
    else:
        out = jobs.update_panel(spark, own, args.datasource) if args.verb == "update" else jobs.demean_panel(spark, own)
    print(f"{out.count()} rows: {', '.join(out.columns)}")


def _analysis(spark, args) -> None:
    from panelspark.plans import jobs
    from panelspark.sources.readers import config

    own = config(args.config)["analysis"]
    if args.verb == "run":
        for name, path in jobs.run_models(spark, own, args.model, args.again).items():
            print(f"{name}: {path}")
    elif args.verb == "tables":
        for text in jobs.result_tables(spark, own, args.formats, args.model).values():
            print(text)
    elif args.verb == "summary":
        jobs.summary(spark, own).show(1000, False)
    elif args.verb == "relabel":
        for old, new in jobs.relabel(spark, own, args.dry_run):
            print(f"{old} -> {new}")
    else:
        print("\n".join(jobs.cleanup(spark, own, args.dry_run)))


if __name__ == "__main__":
    main()
