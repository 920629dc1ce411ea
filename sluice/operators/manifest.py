"""Manifests: profiles of samples, pinned to a file and compared with what is on disk."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractError
from ..plans.plan import IngestionPlan, compile_plan, inject
from ..schemas import CHECKS, PROFILE
from ..sources import files
from .profile import as_pins, profile
from .tables import compare_keys
from .transform import read_rows, require

MANIFEST = (
    "client string, samples array<struct<name:string,sha256:string,bytes:bigint,expected_rows:bigint,amount_sum:string,"
    "null_rate:map<string,double>,distinct:map<string,bigint>>>, scenario struct<injected_defect:string,expected_outcome:string,notes:string>"
)
PLAIN = {"injected_defect": None, "expected_outcome": "pass", "notes": ""}


def profile_samples(spark: SparkSession, root: str, client: str) -> DataFrame:
    """One profile (PROFILE) per sample of a client; expected_rows is the contract's count, else the observed one."""
    spec = files.load_contract(spark, root, client)
    rows = require(read_rows(spark, files.sample_paths(spark, root, client), compile_plan(spec)))
    pins = as_pins(profile(rows))
    disk = files.catalog(spark, root).filter(F.col("client") == client)
    expected = F.coalesce(F.lit(spec.expected_row_count).cast("long"), F.col("rows"))
    both = disk.join(pins, disk["name"] == pins["sample"])
    return both.select("client", "name", "sha256", "bytes", expected.alias("expected_rows"), "amount_sum", "null_rate", "distinct")


def build_manifest(spark: SparkSession, root: str, client: str, scenario: dict | None = None, fallback: dict[str, dict] | None = None) -> dict:
    """A fresh manifest; the scenario is the given one, else the written one's, else that of `fallback`, else plain."""
    samples = [r.asDict() for r in profile_samples(spark, root, client).drop("client").orderBy("name").collect()]
    if not samples:
        raise ContractError(f"{client}: no samples")
    if scenario is None:
        try:
            scenario = load_manifest(spark, root, client)["scenario"]
        except ContractError:
            scenario = (fallback or {}).get(client, PLAIN)
    return {"client": client, "samples": samples, "scenario": {**PLAIN, **scenario}}


def write_manifest(manifest: dict, path: str) -> None:
    """As indented JSON with plain line ends; path is a local one."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(manifest, indent=2) + "\n")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests under root."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/*/manifest.json")


def load_manifest(spark: SparkSession, root: str, client: str) -> dict:
    """One client's manifest."""
    path = f"{root}/{files.safe_name(client)}/manifest.json"
    try:
        row = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    except Exception as e:
        raise ContractError(f"{client}: manifest is missing or invalid") from e
    if row is None or row.client is None or row.samples is None:
        raise ContractError(f"{client}: manifest is invalid")
    return row.asDict(recursive=True)


def pins(spark: SparkSession, manifest: dict) -> DataFrame:
    """The pinned profiles, by sample."""
    rows = [tuple([manifest["client"], *(s[k] for k in ("name", "sha256", "bytes", "expected_rows", "amount_sum", "null_rate", "distinct"))]) for s in manifest["samples"]]
    return spark.createDataFrame(rows, PROFILE).withColumnRenamed("name", "sample")


def pinned_profile(manifest: dict, name: str) -> dict:
    """A pinned profile by name, never worked out anew."""
    for s in manifest["samples"]:
        if s["name"] == name:
            return s
    raise ContractError(f"{manifest['client']}: no pinned profile of {name!r}")


def problems(spark: SparkSession, root: str, client: str) -> DataFrame:
    """(name, problem) of pins that are off and of files without a pin."""
    manifest = load_manifest(spark, root, client)
    pinned = pins(spark, manifest)
    seen = profile_samples(spark, root, client).withColumnRenamed("name", "sample")
    status = compare_keys(pinned.select("sample"), seen.select("sample"), ["sample"]).filter("status <> 'both'")
    lost = status.select("sample", F.when(F.col("status") == "missing", "pinned in the manifest but missing on disk").otherwise("on disk but not pinned in the manifest").alias("problem"))
    a, b = pinned.alias("a"), seen.alias("b")
    both = a.join(b, F.col("a.sample") == F.col("b.sample"))
    cells = [
        F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.concat(F.lit(f"{k} "), F.col(f"b.{k}").cast("string"), F.lit(" is not the pinned "), F.col(f"a.{k}").cast("string")))
        for k in ("sha256", "bytes", "expected_rows", "amount_sum")
    ]
    off = both.select(F.col("a.sample").alias("sample"), F.explode(F.array_compact(F.array(*cells))).alias("problem"))
    return off.unionByName(lost)


def verify_manifest(spark: SparkSession, root: str, client: str) -> None:
    """Raises with all problems of a client."""
    found = problems(spark, root, client).orderBy("sample", "problem").collect()
    if found:
        raise ContractError(f"{client}: " + "; ".join(f"{r.sample}: {r.problem}" for r in found))


def verify_all(spark: SparkSession, root: str) -> None:
    """Raises with all problems of all clients."""
    clients, failed = files.list_clients(spark, root), []
    if not clients:
        raise ContractError(f"no clients under {root}")
    for c in clients:
        try:
            verify_manifest(spark, root, c)
        except ContractError as e:
            failed.append(str(e))
    if failed:
        raise ContractError("\n".join(failed))


#: Wrong plans that the checks must catch: edits of the sound plan, and the checks that must fail.
ADVERSARIAL = {
    "drops_last_row": (lambda p: replace(p, drop_last_row=True), ("H3_completeness",)),
    "wrong_amount_format": (lambda p: replace(p, raw_amounts=True), ("H2_schema",)),
    "slow_network_import": (lambda p: replace(p, source_code="import socket\n"), ("H1_runtime",)),
    "sleeps_past_budget": (lambda p: replace(p, delay_ms=6000), ("H5_latency",)),
    "dag_missing_dependency": (lambda p: inject(p, "dag_missing_dependency"), ("H6_dag_contract",)),
}


def adversarial_plan(name: str, sound: IngestionPlan) -> tuple[IngestionPlan, tuple[str, ...]]:
    """A wrong plan by name, and the checks that it must fail."""
    if name not in ADVERSARIAL:
        raise ContractError(f"no adversarial case {name!r}")
    edit, must_fail = ADVERSARIAL[name]
    return edit(sound), must_fail


CASE_FILES = {"pipeline": "pipeline.py", "dag": "dag.py", "mapping": "mapping.yaml"}
_EXPECT = "against_client string, must_fail array<string>, notes string"


def adversarial_cases(spark: SparkSession, root: str) -> list[dict]:
    """The wrong artifacts under root/_adversarial, by name: their texts, the client they are put to, and the checks that must fail.

    A case without its files, for an unknown client, without checks or with an unknown one is an error; no folder, no cases.
    """
    folder = f"{root}/_adversarial"
    try:
        texts = spark.read.format("binaryFile").load(f"{folder}/*/*")
    except AnalysisException:
        return []
    part = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    pivoted = texts.select(part.alias("name"), files.sample_of(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("text"))
    pivoted = pivoted.groupBy("name").pivot("file", ["expect.json", *CASE_FILES.values()]).agg(F.first("text"))
    expect = F.from_json(F.col("`expect.json`"), _EXPECT)
    rows = pivoted.select("name", expect.alias("e"), *(F.col(f"`{f}`").alias(k) for k, f in CASE_FILES.items())).orderBy("name").collect()
    known, out, wrong = set(files.list_clients(spark, root)), [], []
    for r in rows:
        e = r.e
        if e is None or e.against_client is None:
            wrong.append(f"{r.name}: expect.json is missing or invalid")
        elif e.against_client not in known:
            wrong.append(f"{r.name}: unknown client {e.against_client!r}")
        elif not e.must_fail:
            wrong.append(f"{r.name}: no check that must fail")
        elif unknown := sorted(set(e.must_fail) - set(CHECKS)):
            wrong.append(f"{r.name}: unknown checks {unknown}")
        elif lost := [f for k, f in CASE_FILES.items() if r[k] is None]:
            wrong.append(f"{r.name}: lacks {', '.join(lost)}")
        else:
            out.append({"name": r.name, "against_client": e.against_client, "must_fail": list(e.must_fail), "notes": e.notes or "", **{k: r[k] for k in CASE_FILES}})
    if wrong:
        raise ContractError("; ".join(wrong))
    return out


def plan_of_case(case: dict, sound: IngestionPlan) -> IngestionPlan:
    """The plan that stands for a case: the edit of that name, else the sound plan with the case's code."""
    if case["name"] in ADVERSARIAL:
        return adversarial_plan(case["name"], sound)[0]
    return replace(sound, source_code=case["pipeline"])
