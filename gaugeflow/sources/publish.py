"""Publishing datasets: data first, then the entry of the catalogue that names it."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.sources.dataset import Dataset, build_local, merge_dataset, write_facts
from gaugeflow.sources.files import create_once, names_in, read_text


class Catalogue:
    """Entries of published datasets, a JSON file each version of a member, in a directory of any Hadoop file system."""

    #: What an entry must know.
    NEEDED = ("frequency_interval",)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def validate(self, ds: Dataset) -> dict:
        """metadata, dataset_version_id, state and standard_name of a dataset; ValueError if it lacks what is needed."""
        meta = {k.removeprefix("meta_"): v for k, v in ds.manifest["attributes"].items()}
        gone = [k for k in self.NEEDED if not meta.get(k)]
        if gone:
            raise ValueError(f"metadata lacks {', '.join(gone)}")
        body = json.dumps(ds.manifest, sort_keys=True).encode()
        return {"metadata": meta, "dataset_version_id": hashlib.sha256(body).hexdigest(), "state": "valid", "standard_name": ds.manifest["variables"][ds.manifest["variable"]].get("standard_name")}

    def member_id(self, member_uri: str) -> str:
        """Folder of a member's entries."""
        return hashlib.sha256(member_uri.encode()).hexdigest()[:16]

    def entries(self, member: str) -> list[dict]:
        names = sorted(n for n in names_in(self.spark, f"{self.path}/{member}") if n.endswith(".json"))
        return [json.loads(read_text(self.spark, f"{self.path}/{member}/{n}")) for n in names]

    def publish(self, ds: Dataset, member_uri: str, num_groups: int | None = None) -> dict:
        """Copy what the member lacks, the manifest last, then make the entry. Publishing a version again changes nothing.

        Months whose facts the member has from an earlier version stay; the others are written by the executors (in
        num_groups files, if given) to a folder of their own that counts once the member's manifest names it, so a copy
        that breaks off leaves nothing but an unread folder. copied counts months, the stations and the manifest.
        """
        known, uri, copied = self.validate(ds), member_uri.rstrip("/"), 0
        name = f"{ds.version:012d}.json"
        there = sorted(n for n in names_in(self.spark, f"{uri}/manifests") if n.endswith(".json"))
        if name not in there:
            last = json.loads(read_text(self.spark, f"{uri}/manifests/{there[-1]}")) if there else {"months": {}, "copied_from": {}}
            have, source = last["copied_from"], {m: w for m, w in ds.manifest["months"].items()} | {"stations": ds.manifest["stations"]}
            new = sorted(m for m, w in ds.manifest["months"].items() if have.get(m) != w)
            tag = uuid.uuid4().hex
            months = {m: last["months"][m] for m in ds.manifest["months"] if m not in new}
            if new:
                part = Dataset(self.spark, ds.path, ds.version)
                part.manifest = ds.manifest | {"months": {m: ds.manifest["months"][m] for m in new}}
                months |= write_facts(part.facts(), uri, tag, ds.manifest.get("chunk_shape"), num_groups)
            stations = last.get("stations")
            if have.get("stations") != source["stations"]:
                ds.stations().write.parquet(f"{uri}/stations/{tag}")
                stations, copied = f"stations/{tag}", 1
            create_once(self.spark, f"{uri}/manifests/{name}", json.dumps(ds.manifest | {"months": months, "stations": stations, "copied_from": source}, sort_keys=True))
            copied += len(new) + 1
        entry = known | {"member": member_uri, "version": ds.version}
        try:
            create_once(self.spark, f"{self.path}/{self.member_id(member_uri)}/{name}", json.dumps(entry, sort_keys=True))
        except FileExistsError:
            pass
        return entry | {"copied": copied}


def build_and_publish(catalogue: Catalogue, path: str, member_uri: str, meta: dict, stations: DataFrame, series: DataFrame, *, num_groups: int | None = None, **build) -> dict:
    """build_local, then publish; the entry."""
    return catalogue.publish(build_local(path, meta, stations, series, **build), member_uri, num_groups)


def update_and_publish(catalogue: Catalogue, path: str, member_uri: str, stations: DataFrame, series: DataFrame, *, variable: str | None = None, num_groups: int | None = None) -> dict:
    """merge_dataset, then publish, also if the merge had nothing to do; {'merge': report, 'publish': entry}."""
    ds, report = merge_dataset(Dataset(catalogue.spark, path), stations, series, variable=variable)
    return {"merge": report, "publish": catalogue.publish(ds, member_uri, num_groups)}
