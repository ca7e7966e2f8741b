"""The stage-switched job: ingest -> score interviews -> reports -> score projects -> summary -> sink.

All projects are processed at once (``project`` is a key, never a loop).  The
report stages always run, over every stored answer, so a re-run appends new
answer versions and the latest one wins.

What a run stores (projects, interviews, answers, rejects) becomes visible together, when its manifest is
written (``Store``).  A run that ends before has no effect but one: the answers that the model gave are kept under the run's
number, and the next start, which has the same number, does not ask for them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.operators import reports as R
from fieldwork.operators import scoring as SC
from fieldwork.operators import store as ST
from fieldwork.sources import files as FL
from fieldwork.sources import sinks as SK

MANIFEST_SCHEMA = "table string, folder string, top long, version long"


@dataclass
class Store:
    """Parquet tables below one folder in shared storage, for one writer at a time and any number of readers.

    * ``data/<table>/<version>-<n>``: the rows of one append, never changed later;
    * ``manifests/version=<v>``: one small JSON file with all folders that make up the tables (one row a folder) and
      each table's highest key.  It appears by the rename of one file, and readers see what the newest one lists, so
      all appends of a run are there or none is;
    * ``runs/<v>``: answers of the run that is to become version ``v``, removed after its commit.

    Appends inside ``with store.run():`` are committed at its end (an append outside is a run of its own); the run itself reads
    what it has appended.  After a commit, manifests but the last two, and folders that no kept manifest lists, are deleted.
    """

    spark: SparkSession
    root: str
    pending: list[tuple[str, str]] = field(default_factory=list)
    tops: dict[str, int] = field(default_factory=dict)
    base: tuple[int, list] | None = None  # version and rows of the manifest that the open run started from

    SCHEMAS = {"projects": S.PROJECTS_SCHEMA, "interviews": S.INTERVIEWS_SCHEMA,
               "llm_answers": S.ANSWERS_SCHEMA, "rejects": S.REJECTS_SCHEMA}
    KEYS = {"projects": "project_id", "interviews": "interview_id", "llm_answers": "id"}

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def _manifests(self) -> DataFrame | None:
        path = self.path("manifests")
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).option("basePath", path).json(path)
        except Exception as e:  # nothing was ever committed
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return None
            raise

    def _newest(self) -> tuple[int, list]:
        """Version and rows of the newest manifest: a row a folder, so as many as there were appends."""
        if self.base is not None:
            return self.base
        manifests = self._manifests()
        rows = manifests.collect() if manifests is not None else []
        version = max((r["version"] for r in rows), default=0)
        return version, [r for r in rows if r["version"] == version]

    @property
    def run_path(self) -> str:
        """Where the open run keeps its answers; the same for every start until one is committed."""
        return self.path("runs", str(self._newest()[0] + 1))

    def read(self, table: str) -> DataFrame:
        schema = self.SCHEMAS[table]
        folders = [r["folder"] for r in self._newest()[1] if r["table"] == table]
        folders += [folder for name, folder in self.pending if name == table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path("data", table, f) for f in folders])

    def top(self, table: str) -> int:
        """The highest key ever given out in a table."""
        return self.tops.get(table, max((r["top"] for r in self._newest()[1] if r["table"] == table), default=0))

    def append(self, df: DataFrame, table: str) -> None:
        if self.base is None:
            with self.run():
                return self.append(df, table)
        folder = f"{self.base[0] + 1:08d}-{len(self.pending):03d}"
        path = self.path("data", table, folder)
        df.write.mode("overwrite").parquet(path)  # a run that ended early may have left one
        if table in self.KEYS:
            held = self.spark.read.schema(self.SCHEMAS[table]).parquet(path).agg(F.max(self.KEYS[table])).first()[0]  # one scalar
            self.tops[table] = max(self.top(table), held or 0)
        self.pending.append((table, folder))

    def append_valid(self, rows: DataFrame, table: str, order: list[str] | None = None) -> None:
        """Validated append: valid rows of registered projects, with new keys, to ``table``; the rest to ``rejects``."""
        valid, rejects = ST.validate_rows(rows, table, self.read("projects") if table != "projects" else None)
        if table in self.KEYS:
            valid, _ = ST.with_new_keys(valid, self.KEYS[table], self.top(table), order)
        self.append(valid, table)
        self.append(rejects, "rejects")

    @contextmanager
    def run(self) -> Iterator[Store]:
        """All appends inside become visible together at the end, or never."""
        self.base = self._newest()
        try:
            yield self
            if self.pending:
                self._commit()
        finally:
            self.pending, self.tops, self.base = [], {}, None

    def _commit(self) -> None:
        version, rows = self.base
        live = [(r["table"], r["folder"], max(r["top"], self.tops.get(r["table"], 0))) for r in rows]
        live += [(table, folder, self.top(table)) for table, folder in self.pending]
        listed = self.spark.createDataFrame(live, "table string, folder string, top long").coalesce(1)
        listed.write.mode("errorifexists").json(self.path("manifests", f"version={version + 1}"))
        self._clean(version + 1, {(table, folder) for table, folder, _ in live})

    def _clean(self, version: int, live: set[tuple[str, str]]) -> None:
        """Delete what no reader needs: old manifests but the one before (readers may still hold it; its folders are
        among the live ones), the run's answers, and folders of runs that were never committed."""
        for name in self._names("manifests"):
            if name.startswith("version=") and int(name[8:]) < version - 1:
                self._delete("manifests", name)
        for name in self._names("runs"):
            self._delete("runs", name)
        for table in self.SCHEMAS:
            for name in self._names("data", table):
                if (table, name) not in live:
                    self._delete("data", table, name)

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._folder(*parts)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        fs, path = self._folder(*parts)
        fs.delete(path, True)


def ingest_stage(store: Store, raw_root: str, layout: str = "folders", suffix: str = ".txt") -> None:
    """Register projects found in the files and append each file once (known by project and path).

    Ids follow the store's highest one in the order of project and path, so a repeated start gives the same ones."""
    spark = store.spark
    # the files are read and decoded once; registry, interviews and rejects use the staged table
    good, bad = FL.split_staged(FL.staged_table(FL.read_text_files(spark, raw_root, suffix, layout)))
    projects = store.read("projects")
    registry = ST.register_projects(projects, good.select("project_name"))
    new_projects = registry.join(projects.select("project_name"), "project_name", "left_anti")
    store.append(new_projects.select("project_id", "project_name"), "projects")
    registry = store.read("projects").groupBy("project_name").agg(F.min("project_id").alias("project"))
    fresh = (good.join(registry, "project_name")
             .join(store.read("interviews").select("project", "path"), ["project", "path"], "left_anti")
             .select("project", F.lit(None).cast("timestamp_ntz").alias("date"), "content", "path"))
    store.append_valid(fresh, "interviews", ["project", "path"])
    known = store.read("rejects").select("source", "reason", "payload")
    store.append(bad.join(known, ["source", "reason", "payload"], "left_anti"), "rejects")


def _only(df: DataFrame, projects: DataFrame | None, col: str = "project") -> DataFrame:
    if projects is None:
        return df
    return df.join(F.broadcast(projects.select(F.col("project_id").alias(col))), col, "left_semi")


def run_job(spark: SparkSession, store: Store, raw_root: str | None = None, *, save_files: bool = False,
            process_interviews: bool = False, process_project: bool = False,
            responder=None, project_responder=None, plan=S.QUESTION_PLAN,
            sink_path: str | None = None, layout: str = "folders",
            project_budget_chars: int = 2_000_000, project_names: list[str] | None = None) -> DataFrame:
    """Run the enabled stages; return the report blocks
    ``(project, project_name, report_type, block_no, text)``.

    ``project_names`` limits every stage to those projects (the original tool
    handles one named project per run); by default all projects run at once.
    The name list is a parameter of the run, so broadcasting its ids is bounded
    by what the caller passes.

    The run is committed as a whole before its reports are returned or written.  If it stops before, start it
    again: answers given so far are taken from ``store.run_path``.
    """
    selected = None
    with store.run():
        if save_files:
            ingest_stage(store, raw_root, layout)
        if project_names is not None:
            selected = (store.read("projects").where(F.col("project_name").isin(list(project_names)))
                        .groupBy("project_name").agg(F.min("project_id").alias("project_id")))
        if process_interviews:
            interviews = _only(store.read("interviews"), selected)
            answers, dead = SC.chained_steps(interviews, responder, plan, "interview", store.run_path)
            store.append_valid(SC.answer_rows(answers), "llm_answers")
            store.append(dead.select(F.lit("llm_answers").alias("source"), F.col("error").alias("reason"),
                                     F.to_json(F.struct("project", "interview", "analysis_step")).alias("payload")),
                         "rejects")
        if process_project:
            blocks = R.interviews_report(_only(store.read("llm_answers"), selected)).select(
                "project", F.col("report_no").alias("block_no"), F.col("report_block").alias("text"))
            blocks = SC.persist_table(blocks, "report-blocks")
            calls = SC.project_score(blocks, project_responder, plan, project_budget_chars, store.run_path)
            rows = SC.persist_table(SC.project_answers(calls), "project-answers")
            store.append_valid(SC.answer_rows(rows), "llm_answers")
            store.append(rows.where("error is not null").select(
                F.lit("llm_answers").alias("source"), F.col("error").alias("reason"),
                F.to_json(F.struct("project", "analysis_step")).alias("payload")), "rejects")
    projects = store.read("projects")
    if selected is not None:
        projects = projects.where(F.col("project_name").isin(list(project_names)))
        selected = projects.groupBy("project_name").agg(F.min("project_id").alias("project_id"))
        projects = projects.join(selected.select("project_id"), "project_id", "left_semi")
    out = R.report_blocks(_only(store.read("llm_answers"), selected), projects)
    if sink_path:
        SK.write_reports(out, sink_path)
    return out


def main(argv: list[str] | None = None) -> None:
    """Command line form of the job.

    ``python -m fieldwork.plans.job --store DIR [--raw DIR] [--project NAME ...]
    [--save-files] [--process-interviews] [--process-project] [--client mod:fn]
    [--sink DIR] [--min-interval S] [--partitions N]``

    ``--client`` names a factory ``fn() -> call(request) -> {content, model,
    input_tokens, output_tokens}`` used for the model calls.
    """
    import argparse
    import importlib

    from fieldwork.session import get_session

    ap = argparse.ArgumentParser(prog="fieldwork-job")
    ap.add_argument("--store", required=True)
    ap.add_argument("--raw")
    ap.add_argument("--project", action="append", dest="projects")
    ap.add_argument("--save-files", action="store_true")
    ap.add_argument("--process-interviews", action="store_true")
    ap.add_argument("--process-project", action="store_true")
    ap.add_argument("--client")
    ap.add_argument("--sink")
    ap.add_argument("--layout", default="folders", choices=["folders", "hive"])
    ap.add_argument("--min-interval", type=float, default=0.0)
    ap.add_argument("--partitions", type=int)
    ap.add_argument("--concurrency", type=int, default=1)
    args = ap.parse_args(argv)
    spark = get_session()
    responder = None
    if args.client:
        mod, fn = args.client.split(":")
        factory = getattr(importlib.import_module(mod), fn)
        responder = SC.pandas_responder(factory, min_interval_s=args.min_interval, partitions=args.partitions,
                                        concurrency=args.concurrency)
    elif args.process_interviews or args.process_project:
        ap.error("--client is required to process interviews or projects")
    out = run_job(spark, Store(spark, args.store), args.raw, save_files=args.save_files,
                  process_interviews=args.process_interviews, process_project=args.process_project,
                  responder=responder, project_responder=responder, sink_path=args.sink,
                  layout=args.layout, project_names=args.projects)
    if not args.sink:
        out.groupBy("project_name", "report_type").count().show(truncate=False)


if __name__ == "__main__":
    main()
