"""Studies and sweeps: reconstructions by several methods, evaluated and compared; external tools; provenance."""

from __future__ import annotations

import dataclasses
import itertools
import os
import platform
import re
import shutil
import subprocess
import sys
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions.text import slug
from stillwater.operators import estimate, pixel
from stillwater.plans import evaluate
from stillwater.sources import cases, images, synthetic

BUILTIN: dict[str, Callable[..., DataFrame]] = {
    "mean_stack": lambda frames, case, **_: pixel.mean_stack(frames, case),
    "translation_stack": lambda frames, case, **_: estimate.translation_stack(frames, case),
    "local_block_stack": lambda frames, case, block=32, **_: estimate.block_stack(frames, case, block),
    "single_frame": lambda frames, case, **_: estimate.first_frame(frames, case),
    "oracle_aligned_stack": lambda frames, case, truth=None, **_: estimate.oracle_stack(frames, truth, case),
}
KINDS = ("builtin", "command", "existing_result")


@dataclasses.dataclass(frozen=True)
class Algorithm:
    name: str
    kind: str = "builtin"
    builtin: str | None = None
    command: tuple[str, ...] = ()
    result: str | None = None
    block: int = 32

    def validate(self) -> None:
        if not self.name or self.kind not in KINDS:
            raise ValueError(f"algorithm {self.name!r} has no name or an unknown kind {self.kind!r}")
        given = {"builtin": self.builtin is not None, "command": bool(self.command), "existing_result": self.result is not None}
        if not given[self.kind] or sum(given.values()) != 1:
            raise ValueError(f"algorithm {self.name!r} needs the fields of its kind {self.kind!r} and no others")
        if self.kind == "builtin" and self.builtin not in BUILTIN:
            raise ValueError(f"unknown builtin {self.builtin!r}")
        if self.block < 4:
            raise ValueError("a block has four pixels a side at least")


def validate(algorithms: Sequence[Algorithm]) -> None:
    for a in algorithms:
        a.validate()
    if len(algorithms) < 2:
        raise ValueError("a study compares two algorithms at least")
    if len({a.name for a in algorithms}) != len(algorithms):
        raise ValueError("algorithm names repeat")


def tool_readiness(algorithms: Sequence[Algorithm]) -> list[dict]:
    """For each algorithm whether it can run here, and why not."""
    rows = []
    for a in algorithms:
        reason = None
        if a.kind == "command" and shutil.which(a.command[0]) is None:
            reason = "command_executable_not_found"
        elif a.kind == "existing_result" and not os.path.exists(a.result or ""):
            reason = "result_reconstruction_not_found"
        rows.append({"name": a.name, "kind": a.kind, "is_ready": reason is None, "reason": reason})
    return rows


def run_command(command: Sequence[str], case: str, result: str) -> dict:
    """Runs a tool on an exported case, {case} and {result} filled in; its record is kept before a failure is raised."""
    from stillwater.sources.reports import write_json

    os.makedirs(result, exist_ok=True)
    parts = [p.replace("{case}", case).replace("{result}", result) for p in command]
    began = time.monotonic()
    done = subprocess.run(parts, cwd=os.path.dirname(os.path.abspath(case)), capture_output=True, text=True, check=False)
    record = {"command": parts, "returncode": done.returncode, "stdout": done.stdout, "stderr": done.stderr, "runtime_s": time.monotonic() - began}
    write_json(record, os.path.join(result, "command.json"))
    if done.returncode:
        raise RuntimeError(f"{parts[0]} ended with {done.returncode}")
    return record


def reconstructions(frames: DataFrame, algorithms: Sequence[Algorithm], case: Sequence[str], truth: DataFrame | None = None, loaded: dict[str, DataFrame] | None = None) -> DataFrame:
    """case, algorithm, y, x, v of all algorithms; results of tools are passed in ``loaded`` by name."""
    out = None
    for i, a in enumerate(algorithms):
        made = (loaded or {}).get(a.name)
        if made is None and a.kind == "builtin":
            made = BUILTIN[a.builtin](frames, case, block=a.block, truth=truth)
        if made is None:
            raise KeyError(f"no result of {a.name} was loaded")
        made = made.select(*case, F.lit(a.name).alias("algorithm"), F.lit(i).alias("ordinal"), "y", "x", "v")
        out = made if out is None else out.unionByName(made)
    return out


def study(frames: DataFrame, latent: DataFrame, algorithms: Sequence[Algorithm], case: Sequence[str], truth: DataFrame | None = None, loaded: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """Report rows of every algorithm on every case. Nothing is run unless all algorithms can."""
    validate(algorithms)
    lacking = [r for r in tool_readiness(algorithms) if not r["is_ready"]]
    if lacking:
        raise RuntimeError(f"not ready: {', '.join(r['name'] + ' (' + r['reason'] + ')' for r in lacking)}")
    made = reconstructions(frames, algorithms, case, truth, loaded)
    return evaluate.against_truth(latent, made, [*case, "algorithm", "ordinal"], **options)


@dataclasses.dataclass(frozen=True)
class Sweep:
    warp_strengths: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5)
    noise_sigmas: tuple[float, ...] = (0.0, 0.01, 0.03, 0.06)
    algorithms: tuple[str, ...] = ("single_frame", "mean_stack", "translation_stack", "local_block_stack", "oracle_aligned_stack")
    base: synthetic.Simulation = synthetic.Simulation(frame_count=8)
    size: int = 64
    crater_count: int = 45
    block: int = 32

    def validate(self) -> None:
        if not self.warp_strengths or not self.noise_sigmas or not self.algorithms:
            raise ValueError("a sweep's axes are not empty")
        if min(*self.warp_strengths, *self.noise_sigmas) < 0 or set(self.algorithms) - set(BUILTIN):
            raise ValueError("strengths and noises are 0 at least, algorithms are known ones")
        self.base.validate()

    def scenarios(self) -> list[dict]:
        return [{"scenario": f"warp_{slug(w)}_noise_{slug(n)}", "warp": w, "noise": n} for w, n in itertools.product(self.warp_strengths, self.noise_sigmas)]


def sweep(image: DataFrame, config: Sweep, bins: int = 16) -> DataFrame:
    """Report rows of every scenario and algorithm over one scene (y, x, v). Scenarios are rows: each is simulated by a task of its own."""
    import numpy as np
    import pandas as pd

    config.validate()
    spark = image.sparkSession
    scenarios = spark.createDataFrame(pd.DataFrame(config.scenarios())).repartition(len(config.scenarios()), "scenario")
    scene = pixel.imploded(image.withColumn("scene", F.lit(1)), ["scene"])
    rows = scenarios.withColumn("scene", F.lit(1)).join(F.broadcast(scene), "scene")  # one scene, of the size that the config says

    def run(batches):
        for part in batches:
            out = []
            for row in part.itertuples():
                scales = tuple(dataclasses.replace(s, amplitude_px=s.amplitude_px * row.warp) for s in config.base.warp_scales)
                settings = dataclasses.replace(config.base, warp_scales=scales, global_motion_px=config.base.global_motion_px * row.warp, noise_sigma=row.noise)
                got = synthetic.simulate_case(np.reshape(row.data, (row.h, row.w)).astype(float), settings, settings.random_seed)
                h, w = got["latent"].shape
                out.append((row.scenario, "latent", 0, w, got["latent"].ravel(), None))
                out += [(row.scenario, "frame", i + 1, w, f.ravel(), None) for i, f in enumerate(got["frames"])]
                out += [(row.scenario, "warp", i + 1, w, f[..., 0].ravel(), f[..., 1].ravel()) for i, f in enumerate(got["warps"])]
            yield pd.DataFrame(out, columns=["scenario", "part", "frame", "w", "data", "more"])

    made = rows.mapInPandas(run, "scenario string, part string, frame int, w int, data array<double>, more array<double>")
    pixels = lambda part, *keys: pixel.exploded(made.filter(F.col("part") == part), keys, "data", F.col("w"))
    frames = pixels("frame", "scenario", "frame")
    second = pixel.exploded(made.filter("part = 'warp'"), ("scenario", "frame"), "more", F.col("w")).withColumnRenamed("v", "w_v")
    truth = pixels("warp", "scenario", "frame").withColumnRenamed("v", "u").join(second, ["scenario", "frame", "y", "x"])
    algorithms = [Algorithm(a, builtin=a, block=config.block) for a in config.algorithms]
    return study(frames, pixels("latent", "scenario"), algorithms, ["scenario"], truth, bins=bins)


class Adapter(Protocol):
    """How a method takes part in a study: it is prepared, it runs, and its images (case, y, x, v) are collected."""

    def prepare(self) -> None: ...

    def execute(self) -> None: ...

    def collect_results(self) -> DataFrame: ...


def collected(spark: SparkSession, path: str, case: Sequence[str]) -> DataFrame:
    """case, y, x, v of a result: a Parquet table, or one image file; without its own case it is that of ``case_id`` "case"."""
    if os.path.splitext(path)[1].lower() in (".npy", ".tif", ".tiff"):
        rows = images.pixels(images.load(spark, path)).drop("path")
    else:
        rows = spark.read.parquet(path)
    for c in case:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit("case"))
    return pixel.checked(rows.select(*case, "y", "x", F.col("v").cast("double").alias("v")))


@dataclasses.dataclass
class BuiltinAdapter:
    algorithm: Algorithm
    frames: DataFrame
    case: Sequence[str]
    truth: DataFrame | None = None
    made: DataFrame | None = None

    def prepare(self) -> None:
        self.algorithm.validate()

    def execute(self) -> None:
        self.made = BUILTIN[self.algorithm.builtin](self.frames, self.case, block=self.algorithm.block, truth=self.truth)

    def collect_results(self) -> DataFrame:
        return self.made


@dataclasses.dataclass
class CommandAdapter:
    """A tool that reads the case's folder and leaves ``reconstruction`` (Parquet, .npy or .tif) in its result folder."""

    algorithm: Algorithm
    spark: SparkSession
    folder: str
    result: str
    case: Sequence[str]

    def prepare(self) -> None:
        if shutil.which(self.algorithm.command[0]) is None:
            raise RuntimeError(f"{self.algorithm.name}: command_executable_not_found")
        os.makedirs(self.result, exist_ok=True)

    def execute(self) -> None:
        run_command(self.algorithm.command, self.folder, self.result)

    def collect_results(self) -> DataFrame:
        at = next((p for s in (".npy", ".tif", ".tiff", ".parquet", "") if os.path.exists(p := os.path.join(self.result, f"reconstruction{s}"))), None)
        if at is None:
            raise FileNotFoundError(f"{self.algorithm.name} left no reconstruction in {self.result}")
        return collected(self.spark, at, self.case)


@dataclasses.dataclass
class ExistingAdapter:
    algorithm: Algorithm
    spark: SparkSession
    case: Sequence[str]

    def prepare(self) -> None:
        if not os.path.exists(self.algorithm.result or ""):
            raise RuntimeError(f"{self.algorithm.name}: result_reconstruction_not_found")

    def execute(self) -> None:
        """It was run elsewhere."""

    def collect_results(self) -> DataFrame:
        return collected(self.spark, self.algorithm.result, self.case)


def configured(spark: SparkSession, config: dict, folder: str, out: str, reference: DataFrame | None = None, **options) -> DataFrame:
    """Report rows of a study as its ``config`` says: algorithms of all kinds, in their order, on the case in ``folder``.

    Nothing runs unless all can. Results of tools go to ``out``/results. With a ``reference`` (y, x, v)
    they are scored against that instead of the case's truth; ``options`` go to the evaluation.
    """
    case = ["case_id"]
    algorithms = [Algorithm(**{k: tuple(v) if k == "command" else v for k, v in r.items()}) for r in config["algorithms"]]
    validate(algorithms)
    frames = cases.frames(spark, folder)
    adapters: list[Adapter] = []
    for a in algorithms:
        if a.kind == "builtin":
            adapters.append(BuiltinAdapter(a, frames, case, cases.truth(spark, folder, "warp") if a.builtin == "oracle_aligned_stack" else None))
        elif a.kind == "command":
            adapters.append(CommandAdapter(a, spark, folder, os.path.join(out, "results", f"{len(adapters)}_{re.sub(r'[^A-Za-z0-9._-]+', '_', a.name)}"), case))
        else:
            adapters.append(ExistingAdapter(a, spark, case))
    for x in adapters:
        x.prepare()
    loaded = {}
    runtime = {}
    for a, x in zip(algorithms, adapters, strict=True):
        began = time.monotonic()
        x.execute()
        loaded[a.name] = x.collect_results()
        runtime[a.name] = time.monotonic() - began if a.kind == "command" else None
    made = reconstructions(frames, algorithms, case, None, loaded)
    keys = [*case, "algorithm", "ordinal"]
    if reference is None:
        rows = evaluate.against_truth(cases.truth(spark, folder, "latent"), made, keys, **options)
    else:
        rows = evaluate.against_reference(reference, made, keys, **options)
    took = F.create_map(*(F.lit(x) for n, s in runtime.items() for x in (n, s)))
    return rows.withColumn("reconstruction_runtime_s", F.element_at(took, F.col("algorithm")).cast("double"))


def import_result(spark: SparkSession, path: str, out: str, name: str, source: dict | None = None) -> str:
    """A reconstruction made by hand or elsewhere as a result table of that name, with a record of where it came from."""
    from stillwater.sources.reports import write_json

    rows = collected(spark, path, ["case_id"]).withColumn("algorithm", F.lit(name))
    rows.write.mode("overwrite").partitionBy("case_id").parquet(os.path.join(out, "reconstruction"))
    return write_json({"algorithm": name, "imported_from": os.path.abspath(path), "source": source or {}, "provenance": provenance()}, os.path.join(out, "import.json"))


def provenance() -> dict:
    """Versions, machine and commit; a commit that cannot be told within five seconds is null."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    return {"python": sys.version.split()[0], "spark": pyspark.__version__, "platform": platform.platform(), "machine": platform.machine(), "processor": platform.processor() or None, "pid": os.getpid(), "git_commit": git("rev-parse", "HEAD")}
