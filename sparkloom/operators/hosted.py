"""Sinks for hosted stores.  Each takes a function that makes the store's client, called once in each
task (and on the driver where the store commits); the default needs the store's own package.

Writes are by key, so a task that runs again leaves the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from sparkloom.operators.sinks import Sink


class TurbopufferSink(Sink):
    """Rows as documents of a namespace: ``id_column`` becomes id, ``vector_column`` vector."""

    def __init__(self, namespace: str, id_column: str = "id", vector_column: str | None = None, distance_metric: str | None = None, client: Callable | None = None, rows_a_write: int = 10_000, **write_options):
        self.namespace, self.client, self.rows = namespace, client, rows_a_write
        self.names = {id_column: "id"} | ({vector_column: "vector"} if vector_column else {})
        self.options = write_options | ({"distance_metric": distance_metric} if distance_metric else {})

    def write(self, batches: Iterator) -> Iterator[dict]:
        if self.client is None:
            import turbopuffer

            made = turbopuffer.Turbopuffer()
        else:
            made = self.client()
        space, n = made.namespace(self.namespace), 0
        for b in batches:
            for start in range(0, b.num_rows, self.rows):
                part = b.slice(start, self.rows)
                space.write(upsert_rows=[{self.names.get(k, k): v for k, v in r.items()} for r in part.to_pylist()], **self.options)
                n += part.num_rows
        yield {"rows": n}


class BigtableSink(Sink):
    """Rows by key; each column goes to its family.  What isn't bytes, text or a whole number is written as JSON."""

    def __init__(self, project: str, instance: str, table: str, row_key: str, families: dict[str, str], client: Callable | None = None):
        self.at, self.row_key, self.families, self.client = (project, instance, table), row_key, families, client

    def _table(self):
        project, instance, table = self.at
        if self.client is None:
            from google.cloud import bigtable

            made = bigtable.Client(project=project)
        else:
            made = self.client()
        return made.instance(instance).table(table)

    def write(self, batches: Iterator) -> Iterator[dict]:
        n = 0
        with self._table().mutations_batcher() as out:
            for b in batches:
                if lost := set(b.schema.names) - {self.row_key} - set(self.families):
                    raise ValueError(f"columns without a family: {sorted(lost)}")
                for r in b.to_pylist():
                    row = out.table.direct_row(str(r[self.row_key]).encode())
                    for name, family in self.families.items():
                        if (v := r[name]) is not None:
                            row.set_cell(family, name.encode(), v if isinstance(v, bytes | str) or (isinstance(v, int) and not isinstance(v, bool)) else json.dumps(v, default=str))
                    out.mutate(row)
                n += b.num_rows
        yield {"rows": n}


class Hub:
    """What ``HuggingFaceSink`` asks of the hub, by its package."""

    def __init__(self):
        from huggingface_hub import HfApi

        self.api = HfApi()

    def create(self, repo: str) -> None:
        self.api.create_repo(repo, repo_type="dataset", exist_ok=True)

    def add(self, repo: str, path: str, content: bytes, revision: str):
        """Upload what the commit will name."""
        from huggingface_hub import CommitOperationAdd

        made = CommitOperationAdd(path_in_repo=path, path_or_fileobj=content)
        self.api.preupload_lfs_files(repo, [made], repo_type="dataset", revision=revision)
        return made

    def files(self, repo: str, revision: str) -> list[str]:
        return self.api.list_repo_files(repo, repo_type="dataset", revision=revision)

    def commit(self, repo: str, added: list, removed: list[str], message: str, revision: str) -> None:
        from huggingface_hub import CommitOperationDelete

        self.api.create_commit(repo, [*added, *(CommitOperationDelete(path_in_repo=p) for p in removed)], commit_message=message, repo_type="dataset", revision=revision)


class HuggingFaceSink(Sink):
    """Parquet files of one split of a dataset: tasks upload content, one commit at the end names all files.
    With ``overwrite`` the same commit takes the split's earlier files away.  A file ends at ``file_bytes``."""

    def __init__(self, repo: str, split: str = "train", data_dir: str = "data", revision: str = "main", overwrite: bool = False, commit_message: str = "Upload dataset", client: Callable = Hub, file_bytes: int = 256 << 20):
        self.repo, self.prefix, self.revision, self.overwrite, self.message, self.client, self.file_bytes = repo, f"{data_dir}/{split}-", revision, overwrite, commit_message, client, file_bytes

    def schema(self) -> str:
        return "path string, rows long"

    def start(self) -> None:
        self.client().create(self.repo)

    def write(self, batches: Iterator) -> Iterator[dict]:
        import hashlib
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        from pyspark import TaskContext

        made, part = self.client(), TaskContext.get().partitionId()

        def put(out: io.BytesIO, writer: pq.ParquetWriter, rows: int, k: int) -> dict:
            writer.close()
            content = out.getvalue()
            path = f"{self.prefix}{part:05d}-{hashlib.sha256(content).hexdigest()[:32]}-{k}.parquet"
            return {"path": path, "rows": rows, "added": made.add(self.repo, path, content, self.revision)}

        writer, files = None, 0
        for b in batches:
            if writer is None:
                out, rows = io.BytesIO(), 0
                writer = pq.ParquetWriter(out, b.schema)
            writer.write_table(pa.Table.from_batches([b]))
            rows += b.num_rows
            if out.tell() >= self.file_bytes:
                yield put(out, writer, rows, files)
                writer, files = None, files + 1
        if writer is not None:
            yield put(out, writer, rows, files)

    def finalize(self, results: list[dict]) -> list[dict]:
        made, new = self.client(), {r["path"]: r for r in results}
        old = made.files(self.repo, self.revision) if self.overwrite else []
        made.commit(self.repo, [r["added"] for r in new.values()], [p for p in old if p.startswith(self.prefix) and p not in new], self.message, self.revision)
        return [{"path": p, "rows": r["rows"]} for p, r in new.items()]
