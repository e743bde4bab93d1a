"""Command line: cases, reconstructions, evaluation, comparison, sweeps and readiness over Parquet case stores."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stillwater.operators import gather, pixel, rank, spectral
from stillwater.plans import evaluate, study
from stillwater.sources import cases, images, reports, synthetic


def session() -> SparkSession:
    return SparkSession.builder.appName("stillwater").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def simulate(a: argparse.Namespace) -> int:
    import numpy as np

    spark = session()
    config = synthetic.Simulation.from_record(reports.read_json(a.config)) if a.config else synthetic.Simulation()
    config = study.dataclasses.replace(config, **{k: v for k, v in (("frame_count", a.frames), ("random_seed", a.seed), ("noise_sigma", a.noise), ("downsample", a.downsample)) if v is not None})
    if a.warp is not None:
        config = study.dataclasses.replace(config, warp_scales=tuple(study.dataclasses.replace(x, amplitude_px=x.amplitude_px * a.warp) for x in config.warp_scales))
    config.validate()
    if a.truth:
        scene = images.pixels(images.load(spark, a.truth)).drop("path")
    else:
        scene = synthetic.crater_image(spark, spark.createDataFrame(synthetic.craters(np.random.default_rng(config.random_seed), a.size, a.size)), a.size, a.size)
    scene = scene.withColumn("case_id", F.lit(a.case_id))
    latent = scene if config.downsample == 1 else gather.block_average(scene, ["case_id"], config.downsample)
    cases.save(a.out, frames=synthetic.simulate(scene, ["case_id"], config), latent=latent)
    return 0


def import_observation(a: argparse.Namespace) -> int:
    cases.import_observation(a.out, images.load(session(), *a.frames), a.case_id)
    return 0


def stack(a: argparse.Namespace) -> int:
    frames = cases.frames(session(), a.case)
    made = study.BUILTIN[a.method](frames, ["case_id"], block=a.block)
    made.withColumn("algorithm", F.lit(a.method)).write.mode("overwrite").partitionBy("case_id").parquet(a.out)
    return 0


def run_command(a: argparse.Namespace) -> int:
    study.run_command(a.command, a.case, a.out)
    return 0


def evaluated(a: argparse.Namespace) -> int:
    spark = session()
    rows = evaluate.against_truth(cases.truth(spark, a.case, "latent"), spark.read.parquet(a.result), ["case_id", "algorithm"], bins=a.bins)
    got = [r.asDict(True) for r in evaluate.nested(rows, ["case_id", "algorithm"]).collect()]  # one row a reconstruction
    reports.write_json({"reports": got, "provenance": study.provenance()}, a.out)
    return 0


def report(a: argparse.Namespace) -> int:
    with open(a.out, "w", encoding="utf-8") as f:
        f.write("\n".join(reports.metrics_markdown(r) for r in reports.read_json(a.metrics)["reports"]))
    return 0


def compare(a: argparse.Namespace) -> int:
    spark = session()
    flat = []
    for path in a.metrics:
        for r in reports.read_json(path)["reports"]:
            flat.append({"ordinal": len(flat), "algorithm": r["algorithm"], **r["image_similarity"], **r["structural_accuracy"], "correlation_0_5_limit_fraction": r["frequency_recovery"]["correlation_0_5_limit_fraction"], "unsupported_energy_fraction": r["false_detail"]["unsupported_energy_fraction"]})
    names = ("mse", "psnr_db", "ssim_global", "gradient_correlation", "correlation_0_5_limit_fraction", "unsupported_energy_fraction")
    rows = spark.createDataFrame([(r["ordinal"], r["algorithm"], *(float(r[n]) for n in names)) for r in flat], "ordinal int, algorithm string, " + ", ".join(f"{n} double" for n in names)).withColumn("score", rank.score())
    ranked, leaders = evaluate.comparison(rows)
    ranked, leaders = ([x.asDict() for x in df.collect()] for df in (ranked.orderBy("rank"), leaders))
    if a.format == "json":
        reports.write_json({"rows": ranked, "leaders": leaders}, a.out)
    else:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(reports.comparison_markdown(ranked, leaders))
    return 0


def sweep(a: argparse.Namespace) -> int:
    import numpy as np

    spark = session()
    record = reports.read_json(a.config) if a.config else {}
    config = study.Sweep(**{k: tuple(v) if isinstance(v, list) else v for k, v in record.items()})
    scene = synthetic.crater_image(spark, spark.createDataFrame(synthetic.craters(np.random.default_rng(config.base.random_seed), config.size, config.size, config.crater_count)), config.size, config.size)
    study.sweep(scene, config).write.mode("overwrite").parquet(a.out)
    return 0


def tool_readiness(a: argparse.Namespace) -> int:
    rows = study.tool_readiness([study.Algorithm(**{k: tuple(v) if k == "command" else v for k, v in r.items()}) for r in reports.read_json(a.config)["algorithms"]])
    print(reports.table(rows, ["name", "kind", "is_ready", "reason"]))
    return 0 if all(r["is_ready"] for r in rows) else 1


def diagnostics(a: argparse.Namespace) -> int:
    spark = session()
    truth, made = cases.truth(spark, a.case, "latent"), spark.read.parquet(a.result)
    keys = ["case_id", "algorithm"]
    shared = [k for k in keys if k in truth.columns]
    high = pixel.paired(spectral.high_pass_dense(truth, shared), spectral.high_pass_dense(made, keys), keys)
    maps = {"truth": truth, "reconstruction": made, "residual": pixel.residual(truth, made, keys), "edge": pixel.edge_residual(pixel.paired(truth, made, keys), keys), "false_detail": spectral.false_detail_map(high, keys)}
    first = cases.frames(spark, a.case, frame=1)
    extent = lambda df: df.agg(F.max("y"), F.max("x")).first()
    if tuple(extent(first)) == tuple(extent(made)):  # frames that the sensor has not made smaller
        maps["blink"] = first.select("case_id", F.lit("degraded").alias("algorithm"), "y", "x", "v").unionByName(made.select(*keys, "y", "x", "v"))
    for name, df in maps.items():
        df.select(*(k for k in keys if k in df.columns), "y", "x", "v").write.mode("overwrite").parquet(f"{a.out}/{name}")
    curve = spectral.radial_curve(truth, made, keys, a.bins, spectral.dft_dense)
    curve.orderBy(*keys, "bin").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.out}/frequency_recovery")  # a row a bin
    if os.path.isdir(f"{a.case}/truth/warp"):
        far = F.hypot("u", "v")
        stats = [f(far).alias(n) for n, f in (("mean_px", F.avg), ("max_px", F.max), ("rms_px", lambda c: F.sqrt(F.avg(c * c))))]
        warps = {"combined": cases.truth(spark, a.case, "warp")}
        if os.path.isdir(f"{a.case}/truth/component"):
            warps["components"] = cases.truth(spark, a.case, "component")
        by = {"combined": ["case_id"], "components": ["case_id", "component"]}
        reports.write_json({n: [r.asDict() for r in df.groupBy(*by[n]).agg(*stats).orderBy(*by[n]).collect()] for n, df in warps.items()}, f"{a.out}/warp_summary.json")
    return 0


def evaluate_reference(a: argparse.Namespace) -> int:
    spark = session()
    reference = images.pixels(images.load(spark, a.reference)).drop("path")
    record = reports.read_json(a.record) if a.record else None
    begun = time.monotonic()
    rows = evaluate.against_reference(reference, spark.read.parquet(a.result), ["case_id", "algorithm"], a.registration, a.photometry, a.limitation, record=record, output=a.reference, bins=a.bins)
    got = [r.asDict(True) for r in evaluate.nested(rows, ["case_id", "algorithm"]).join(rows.select("case_id", "algorithm", "uncertainty", "risk_level"), ["case_id", "algorithm"]).collect()]
    known = {"benchmark_mode": "standalone_reference", **evaluate.reference_metadata(record, a.reference, a.limitation), "evaluation_runtime_s": time.monotonic() - begun}
    got = [{**r, "metadata": known} for r in got]
    reports.write_json({"reports": got, "provenance": study.provenance()}, a.out)
    return 0


def builtin_study(a: argparse.Namespace) -> int:
    spark = session()
    made = [study.Algorithm(n, builtin=n, block=a.block) for n in ("mean_stack", "translation_stack", "local_block_stack")]
    study.study(cases.frames(spark, a.case), cases.truth(spark, a.case, "latent"), made, ["case_id"], bins=a.bins).write.mode("overwrite").parquet(a.out)
    return 0


def render_reference(a: argparse.Namespace) -> int:
    from stillwater.plans import render

    source = images.pixels(images.load(session(), a.source))
    render.telescope_reference(source, ["path"], a.sigma, airy_r0=a.airy_r0).write.mode("overwrite").parquet(a.out)
    return 0


def validate_manifest(a: argparse.Namespace) -> int:
    from stillwater.plans import products

    rows = [r.asDict() for r in products.validation(products.manifests(session(), *a.manifests)).collect()]
    print(reports.table(rows, ["path", "is_valid", "error", "n_documents", "n_products", "status"]))
    return 0 if all(r["is_valid"] for r in rows) else 1


def roi_statuses(a: argparse.Namespace):
    from stillwater.plans import products

    spark = session()
    needed = products.requirements(products.regions(spark, a.roi), products.manifests(spark, a.manifests))
    return products, spark, products.file_statuses(needed, products.local_files(spark, a.root), products.labels_below(spark, a.root, a.labels))


def roi_readiness(a: argparse.Namespace) -> int:
    products, _, statuses = roi_statuses(a)
    rows = [r.asDict(True) for r in products.readiness(statuses).collect()]
    reports.write_json(rows, a.out)
    return 0 if all(r["is_ready"] for r in rows) else 1


def roi_download_plan(a: argparse.Namespace) -> int:
    products, _, statuses = roi_statuses(a)
    reports.write_json([r.asDict(True) for r in products.download_plan(statuses).orderBy("roi", "ordinal", "destination").collect()], a.out)
    return 0


def extract_roi(a: argparse.Namespace) -> int:
    products, spark, statuses = roi_statuses(a)
    made, skipped = products.extraction(spark, statuses, a.root)
    reports.write_json([r.asDict(True) for r in skipped.select("roi", "role", "path", "reason").collect()], f"{a.out}.skipped.json")
    made.write.mode("overwrite").partitionBy("path").parquet(a.out)
    return 0 if not made.isEmpty() else 1


def reproject_roi(a: argparse.Namespace) -> int:
    from stillwater.plans import render

    source = session().read.parquet(a.source)
    out = render.reprojected(source, ["path"], a.width_km, a.height_km, a.m_per_px)
    out.write.mode("overwrite").partitionBy("path").parquet(a.out)
    return 0 if not out.isEmpty() else 1


def fetch_products(a: argparse.Namespace) -> int:
    from stillwater.sources import fetch

    plan = [r for r in reports.read_json(a.plan) if r["kind"] == "product"]
    if a.names:
        plan = fetch.named([{"name": os.path.basename(r["destination"]), **r} for r in plan], a.names)
    labels_ = [r for r in reports.read_json(a.plan) if r["kind"] == "label"]
    for r in labels_:
        fetch.text(r["url"], fetch.target(a.root, r["destination"]))
    fetch.products(plan, a.root, a.max_total_bytes)
    return 0


def declared(a: argparse.Namespace, column: str) -> list[dict]:
    """The entries of sound manifests' lists; an unsound manifest fails."""
    from stillwater.plans import products

    rows = products.manifests(session(), *a.manifests)
    bad = products.validation(rows).filter("NOT is_valid OR source_error IS NOT NULL").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['error'] or bad['source_error']}")
    return [x.asDict() for r in rows.orderBy("path").select(column).collect() for x in r[0] or []]


def fetch_metadata(a: argparse.Namespace) -> int:
    from stillwater.sources import fetch

    fetch.documents(declared(a, "metadata_documents"), a.root)
    return 0


def fetch_labels(a: argparse.Namespace) -> int:
    from stillwater.sources import fetch

    fetch.product_labels(declared(a, "product_files"), a.root)
    return 0


def configured_study(a: argparse.Namespace) -> int:
    spark = session()
    reference = images.pixels(images.load(spark, a.reference)).drop("path") if a.reference else None
    study.configured(spark, reports.read_json(a.config), a.case, a.out, reference, bins=a.bins).write.mode("overwrite").parquet(f"{a.out}/reports")
    return 0


def import_result(a: argparse.Namespace) -> int:
    study.import_result(session(), a.result, a.out, a.name, reports.read_json(a.source) if a.source else None)
    return 0


def spice_readiness(a: argparse.Namespace) -> int:
    from stillwater.plans import ephemeris

    reports.write_json(ephemeris.kernel_report(session(), a.observation, a.manifest, a.root), a.out)
    return 0


def spice_observation(a: argparse.Namespace) -> int:
    from stillwater.plans import ephemeris

    reports.write_json(ephemeris.geometry_report(session(), a.observation, a.root), a.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stillwater")
    sub = p.add_subparsers(required=True)

    def command(name, run, *args):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, options in args:
            c.add_argument(*flags, **options)

    out, case, result = (["--out"], {"required": True}), (["--case"], {"required": True}), (["--result"], {"required": True})
    number = lambda name, kind=int: ([f"--{name}"], {"type": kind})
    name = (["--case-id"], {"default": "case"})
    command("simulate", simulate, out, name, (["--config"], {}), (["--truth"], {}), (["--size"], {"type": int, "default": 256}), number("frames"), number("seed"), number("downsample"), number("noise", float), number("warp", float))
    command("import-observation", import_observation, out, name, (["frames"], {"nargs": "+"}))
    command("stack", stack, case, out, (["--method"], {"default": "mean_stack", "choices": [m for m in study.BUILTIN if m != "oracle_aligned_stack"]}), (["--block"], {"type": int, "default": 32}))
    command("run-command", run_command, case, out, (["command"], {"nargs": "+"}))
    command("evaluate", evaluated, case, result, out, (["--bins"], {"type": int, "default": 32}))
    command("diagnostics", diagnostics, case, result, out, (["--bins"], {"type": int, "default": 32}))
    command("study", configured_study, case, out, (["--config"], {"required": True}), (["--reference"], {}), (["--bins"], {"type": int, "default": 32}))
    command("import-result", import_result, result, out, (["--name"], {"required": True}), (["--source"], {}))
    command("fetch-metadata", fetch_metadata, (["--root"], {"required": True}), (["manifests"], {"nargs": "+"}))
    command("fetch-labels", fetch_labels, (["--root"], {"required": True}), (["manifests"], {"nargs": "+"}))
    sky = [(["--observation"], {"required": True}), (["--root"], {"default": "."})]
    command("spice-readiness", spice_readiness, out, (["--manifest"], {"required": True}), *sky)
    command("spice-observation", spice_observation, out, *sky)
    command("report", report, out, (["metrics"], {}))
    command("compare", compare, out, (["--format"], {"default": "markdown", "choices": ["markdown", "json"]}), (["metrics"], {"nargs": "+"}))
    command("synthetic-sweep", sweep, out, (["--config"], {}))
    command("evaluate-reference", evaluate_reference, result, out, (["--reference"], {"required": True}), (["--registration"], {"default": "none", "choices": ["none", "integer_phase_correlation_translation"]}), (["--photometry"], {"default": "none", "choices": ["none", "linear_least_squares"]}), (["--limitation"], {"action": "append", "default": []}), (["--record"], {}), (["--bins"], {"type": int, "default": 32}))
    command("builtin-baselines", builtin_study, case, out, (["--block"], {"type": int, "default": 32}), (["--bins"], {"type": int, "default": 32}))
    command("telescope-reference", render_reference, out, (["--source"], {"required": True}), (["--sigma"], {"type": float, "default": 1.656}), (["--airy-r0"], {"type": float}))
    command("validate-manifest", validate_manifest, (["manifests"], {"nargs": "+"}))
    roi = [(["--roi"], {"required": True}), (["--manifests"], {"required": True}), (["--root"], {"required": True}), (["--labels"], {"default": "data/metadata"})]
    command("roi-readiness", roi_readiness, out, *roi)
    command("roi-download-plan", roi_download_plan, out, *roi)
    command("extract-roi", extract_roi, out, *roi)
    command("reproject-roi", reproject_roi, out, (["--source"], {"required": True}), *((([f"--{n}"], {"type": float, "required": True})) for n in ("width-km", "height-km", "m-per-px")))
    command("fetch-products", fetch_products, (["plan"], {}), (["--root"], {"required": True}), (["--max-total-bytes"], {"type": int, "required": True}), (["--name"], {"action": "append", "dest": "names"}))
    command("tool-readiness", tool_readiness, (["config"], {}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
