"""python -m hitflow run --hits FILE --edges FILE --out FOLDER [--config FILE], or --synth NS in place of files.

Other commands run one stage from the files that the stages before it have left in FOLDER: load (writes hits and pulses there), edges,
clusters, features, tof, labels, trees, network, diagnostics, figures. resume --from STAGE runs that stage and all after it.
With --raw MODULE:FUNCTION, --hits names raw files (comma-separated) that the function reads.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import synth
from .plans import figures, pipeline
from .sources import Config, choose_source, load_config, load_edges, load_raw


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="hitflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["run", "resume", "load", *pipeline.STAGES])
    for name in ("--hits", "--edges", "--config", "--raw"):
        p.add_argument(name)
    p.add_argument("--out", required=True)
    p.add_argument("--from", dest="first", choices=list(pipeline.STAGES), help="the stage with which resume begins")
    p.add_argument("--synth", type=float, default=3e6, help="length of generated data in ns")
    p.add_argument("--synth-only", action="store_true")
    p.add_argument("--no-classifier", action="store_true")
    p.add_argument("--no-network", action="store_true")
    p.add_argument("--no-figures", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("hitflow").getOrCreate()
    config = load_config(a.config) if a.config else Config()
    work = pipeline.Work(spark, a.out, config)
    if a.command in ("run", "load"):
        generate = lambda s: (synth.synth_hits(s, a.synth, config.seed)[0], synth.synth_edges(s, a.synth, seed=config.seed))
        raw = (lambda s: (load_raw(s, a.hits.split(","), a.raw), load_edges(s, a.edges))) if a.raw else None
        hits, pulses = choose_source(spark, raw, a.hits, a.edges, generate, a.synth_only)
        work.given = {"hits": hits, "pulses": pulses}
        pipeline.load(work)
        work.given = {}
    if a.command == "load":
        return ""
    skipped = {"trees", "network"} if a.no_classifier else {"network"} if a.no_network else set()
    skipped |= {"figures"} if a.no_figures else set()
    names = [s for s in pipeline.STAGES if s not in skipped]
    if a.command == "resume":
        names = names[names.index(a.first or names[0]) :]
    elif a.command != "run":
        names = [a.command]
    out = pipeline.run_stages(work, names)
    text = pipeline.markdown(out) + ("\n" + pipeline.diagnostics(out) if "diagnostics" in names else "")
    figures.write_text(spark, text, f"{a.out}/report_{a.command}.md")
    print(text)
    return text


if __name__ == "__main__":
    main()
