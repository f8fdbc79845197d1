"""Jobs over a wiki's folder: reading its tables once, and what commands compose from the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constitution import Constitution
from ..operators import graph, merge, provenance, quality, retrieval, rules, state
from ..operators import pages as P
from ..sources import markdown
from ..streaming import recheck
from .incremental import Store
from .stages import cut

SCHEDULE = "page string, confidence string, total_checks long, stale_count long, clean_count long, interval_h double, last_checked_at timestamp_ntz, next_check_after timestamp_ntz"

LAST_QUERY = "question string, ord long, stem string, section string"


class Wiki:
    """A folder with wiki/ (pages and sidecars), sources/ and tables/ (what jobs write, as Parquet or JSON)."""

    def __init__(self, spark: SparkSession, root: str, now: str, rules_path: str | None = None):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.rules = Constitution.load(rules_path) if rules_path else Constitution()
        self._held: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        """A table that several operators read is made and written once."""
        if name not in self._held:
            self._held[name] = cut(make())
        return self._held[name]

    def changed(self) -> None:
        self._held.clear()

    @property
    def today(self) -> str:
        return self.now[:10]

    def pages(self) -> DataFrame:
        return self._once("pages", lambda: markdown.read_pages(self.spark, f"{self.root}/wiki"))

    def drafts(self) -> DataFrame:
        return self.pages().where("dir = 'drafts'")

    def whole_sidecars(self) -> DataFrame:
        return self._once("sidecars", lambda: markdown.read_sidecars(self.spark, f"{self.root}/wiki"))

    def sidecars(self) -> DataFrame:
        return markdown.flat(self.whole_sidecars())

    def sources(self) -> DataFrame:
        return self._once("sources", lambda: markdown.read_sources(self.spark, f"{self.root}/sources"))

    def files(self) -> DataFrame:
        return self.sources().select("path", "content_hash")

    def manifest(self) -> DataFrame:
        try:
            own = self.spark.read.schema(markdown.MANIFEST).json(f"{self.root}/tables/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            own = self.spark.createDataFrame([], markdown.MANIFEST)
        return own.unionByName(markdown.read_manifest(self.spark, *(f"{self.root}/sources/{n}" for n in ("manifest.json", "manifest.example.json"))))

    def schedule(self) -> DataFrame:
        return markdown.read_json(self.spark, f"{self.root}/tables/schedule", SCHEDULE)

    def log(self, event: str, summary: str) -> None:
        markdown.append_log(self.spark, f"{self.root}/tables/log", self.now, event, summary)

    # ---- what is asked

    def issues(self) -> DataFrame:
        return self._once("issues", lambda: rules.lint(self.pages(), self.sidecars(), self.files(), self.rules))

    def validation(self) -> DataFrame:
        return rules.validate(self.drafts(), self.pages(), self.sidecars(), self.rules)

    def stale(self) -> DataFrame:
        return provenance.stale_sources(self.sidecars(), self.files()).select("stem").distinct()

    def page_state(self) -> DataFrame:
        return state.page_state(self.pages(), self.sidecars(), self.files())

    def query(self, question: str, depth: int = 2, top: int = 5, expand: bool = True, budget: int = 50_000) -> DataFrame:
        """The context of a question: sections of the pages that are reached, or, without any pages, the sources that mention its words."""
        if P.wiki(self.pages()).isEmpty():
            return retrieval.search(self.sources().select("filename", "source_type", "text"), question, top)
        asked = retrieval.variants(question) if expand else [question]
        found = graph.reached(retrieval.seeds(self.pages(), asked, top), graph.edges(self.pages()), P.wiki(self.pages()), depth)
        ranked = found.withColumnRenamed("rank", "ord").join(self.pages().select("stem", "type", "confidence", "content"), "stem")
        return retrieval.context(ranked, budget).orderBy("ord")

    def pack(self, question: str, depth: int = 2, top: int = 5) -> retrieval.Pack:
        return retrieval.pack(self.pages(), self.stale(), self.issues, question, depth, top)

    def quality(self) -> DataFrame:
        return quality.page_quality(self.pages(), self.issues(), self.sidecars(), self.files())

    def coverage(self, source: str | None = None) -> DataFrame:
        named = self.sources().select(F.col("filename").alias("source"), "text")
        named = named if source is None else named.where(F.col("source") == source)
        heads = P.headings(named, "text", 6).select("source", "heading")
        return quality.coverage(self.pages(), named.select("source").join(heads, "source", "left"))

    def uncovered(self, source: str) -> DataFrame:
        """ord, heading of a source's headings that no page cites."""
        named = self.sources().where(F.col("filename") == source).select(F.col("filename").alias("source"), "text")
        cited = P.citations(P.wiki(self.pages())).where(T.base_name(F.trim("file")) == source).select(F.lower(F.trim("section")).alias("key")).distinct()
        return P.headings(named, "text", 6).withColumn("key", F.lower("heading")).join(cited, "key", "left_anti").select("ord", "heading").orderBy("ord")

    # ---- what is written

    def register(self, incoming: DataFrame) -> DataFrame:
        """Sources (filename, text) whose content is new join the manifest and the folder of their type."""
        new = cut(merge.registered(incoming, self.manifest(), self.now))
        texts = incoming.withColumn("content_hash", T.content_hash(F.col("text"))).join(new.select("filename", "source_type", "content_hash"), ["filename", "content_hash"]).dropDuplicates(["filename", "content_hash"])
        markdown._write(texts.select(F.concat("source_type", F.lit("/"), "filename").alias("path"), F.col("text").alias("raw")), f"{self.root}/sources")
        new.withColumns({c: F.array().cast("array<string>") for c in ("concepts_generated", "entities_generated")}).write.mode("append").json(f"{self.root}/tables/manifest")
        self.changed()
        self.log("register", "sources registered")
        return new

    def _commit(self, files: DataFrame, gone: DataFrame) -> None:
        """Writes files (path, raw) to the wiki's folder and removes others (path), as one step that can be taken up again.

        All of it is first written to tables/pending. Once that is whole, what is left of it is done by whoever comes
        next, should this job end between two files: each is replaced by the same content, or is gone already.
        """
        files.select("path", "raw").unionByName(gone.select("path", F.lit(None).cast("string").alias("raw"))).write.mode("overwrite").parquet(f"{self.root}/tables/pending")
        self.recover()

    def recover(self) -> bool:
        """Ends a step that an earlier job began; whether there was one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tables/pending")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        whole = store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
        if whole:
            plan = self.spark.read.schema("path string, raw string").parquet(f"{self.root}/tables/pending")
            markdown._write(plan.where("raw IS NOT NULL"), f"{self.root}/wiki")
            markdown.remove(plan.where("raw IS NULL"), f"{self.root}/wiki")
            store.delete(path, True)
            self.changed()
        return whole

    def _claims(self, pages: DataFrame) -> DataFrame:
        """dir, stem, claims that pages hold now."""
        found = pages.select("dir", "stem", P.claim_array(F.col("content"), F.col("confidence")).alias("found"))
        return found.select("dir", "stem", F.transform("found", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"), c["sources"].alias("sources"))).alias("claims"))

    def _joined_sidecars(self, done: DataFrame, incoming: DataFrame) -> DataFrame:
        """The sidecars of pages (done), joined to others that come to them (incoming: dir, stem, from_dir, from_stem), with claims read anew."""
        whole = self.whole_sidecars().where("NOT corrupt")
        keys = incoming.select("dir", "stem", F.col("from_dir").alias("d"), F.col("from_stem").alias("s"))
        came = whole.withColumnsRenamed({"dir": "d", "stem": "s"}).join(keys, ["d", "s"])
        fields = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "d", F.coalesce(c, F.array().cast(whole.schema[c].dataType)).alias("x")))), lambda r: r["x"])).alias(c) for c in ("sources", "claims", "derived_concepts")]
        key = F.concat_ws("/", "dir", "stem").alias("stem")
        own = whole.join(done.select("dir", "stem"), ["dir", "stem"], "left_semi").select(key, "sources", "claims", "derived_concepts")
        joint = provenance.merged(own, came.groupBy("dir", "stem").agg(*fields).select(key, "sources", "claims", "derived_concepts")).withColumnRenamed("stem", "key").drop("claims")
        met = done.withColumn("key", F.concat_ws("/", "dir", "stem")).join(joint, "key").join(self._claims(done), ["dir", "stem"])
        return met.select("dir", "stem", F.col("stem").alias("page"), T.content_hash(F.col("content")).alias("content_hash"), "sources", "claims", "derived_concepts")

    def promote(self) -> DataFrame:
        """Moves drafts without errors to their folders, with their sidecars joined to those that were there and claims read anew; drafts and their sidecars are gone then."""
        self.recover()
        issues = cut(self.validation())
        going = cut(merge.promotable(self.drafts(), issues))
        done = cut(merge.promoted(self.drafts(), self.pages(), issues).join(going.select("dir", "stem"), ["dir", "stem"], "left_semi"))
        sidecars = self._joined_sidecars(done, going.select("dir", "stem", F.lit("drafts").alias("from_dir"), F.col("stem").alias("from_stem")))
        left = going.select(F.explode(F.array("path", F.concat("path", F.lit(".provenance.json")))).alias("path"))
        self._commit(markdown.rendered(done).unionByName(markdown.sidecar_files(sidecars)), left)
        self.log("promote", "drafts promoted")
        return issues

    def merge(self, mapping: DataFrame) -> DataFrame:
        """Merges pages (mapping: secondary, primary; chains and cycles are resolved) with their sidecars, and rewrites the links of all others. Returns secondary, primary of what was merged."""
        self.recover()
        pages, own = self.pages(), P.wiki(self.pages())
        leads = cut(merge.roots(mapping).join(own.select(F.col("stem").alias("primary")).distinct(), "primary"))
        others = pages.join(own.select("dir", "stem"), ["dir", "stem"], "left_anti")
        done = cut(merge.merged_all(own, mapping, self.today).unionByName(merge.relinked(others, leads)))
        kept = done.select("dir", "stem", F.col("content").alias("now"), F.col("aliases").alias("names"))
        was = pages.select("dir", "stem", "content", "aliases")
        changed = kept.join(was, ["dir", "stem"]).where(~F.col("now").eqNullSafe(F.col("content")) | ~F.col("names").eqNullSafe(F.col("aliases"))).select("dir", "stem")
        new = cut(done.join(changed, ["dir", "stem"], "left_semi").withColumn("content_hash", T.content_hash(F.col("content"))))
        gone = cut(pages.join(done.select("dir", "stem"), ["dir", "stem"], "left_anti").select("dir", "stem", "path"))
        met = cut(leads.join(gone.select(F.col("stem").alias("secondary"), F.col("dir").alias("from_dir")), "secondary"))
        incoming = met.join(new.select("dir", F.col("stem").alias("primary")), "primary").select("dir", F.col("primary").alias("stem"), "from_dir", F.col("secondary").alias("from_stem"))
        sidecars = self._joined_sidecars(new, incoming)
        left = gone.select(F.explode(F.array("path", F.concat("path", F.lit(".provenance.json")))).alias("path"))
        self._commit(markdown.rendered(new).unionByName(markdown.sidecar_files(sidecars)), left)
        self.log("merge", "pages merged")
        return met.select("secondary", "primary")

    def refresh_claims(self) -> None:
        """Sidecars get the claims that their pages hold now."""
        whole = self.whole_sidecars().where("NOT corrupt").drop("claims").join(self._claims(P.wiki(self.pages())), ["dir", "stem"])
        markdown.write_sidecars(whole.select("dir", "stem", "page", "content_hash", "sources", "claims", "derived_concepts"), f"{self.root}/wiki")
        self.changed()

    def migrate(self, created: str) -> None:
        """Older pages get what they lack, and a sidecar if they have none."""
        done = cut(P.migrated(P.wiki(self.pages()), created))
        markdown.write_pages(done, f"{self.root}/wiki")
        now = provenance.resolved(self.files())
        bare = done.join(self.whole_sidecars().select("stem"), "stem", "left_anti")
        each = bare.select("dir", "stem", "content_hash", F.explode("source_refs").alias("file")).join(now.withColumnRenamed("content_hash", "now"), "file", "left")
        made = each.groupBy("dir", "stem", "content_hash").agg(F.array_sort(F.collect_list(F.struct("file", F.coalesce("now", F.lit("")).alias("content_hash"), F.array().cast("array<string>").alias("sections_used")))).alias("sources"))
        markdown.write_sidecars(made.select("dir", "stem", F.col("stem").alias("page"), "content_hash", "sources"), f"{self.root}/wiki")
        self.changed()

    def indexes(self) -> None:
        """Index pages by type, topic and source, those updated lately, and the timeline."""
        own = self.pages()
        for name, title, key in (("_index", "Wiki Index", merge.types()), ("by-topic", "By Topic", merge.exploded("tags", "untagged")), ("by-source", "By Source", merge.exploded("source_refs", "no-source"))):
            groups = merge.listed(own, key).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
            body = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "lines"))), lambda g: F.concat(F.lit("## "), g["key"], F.lit("\n\n"), g["lines"])), "\n\n").alias("content"))
            self._generated("indexes", name, title, "index", body)
        recent = merge.recently_updated(own, self.today).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "stem")), False), lambda r: F.concat(F.lit("- [["), r["stem"], F.lit("]] — "), r["date"])), "\n").alias("content"))
        self._generated("indexes", "recently-updated", "Recently Updated", "index", recent)
        months = merge.timeline(own).groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "created", "stem"))), lambda r: F.concat(F.lit("- "), r["created"], F.lit(" [["), r["stem"], F.lit("]]"))), "\n").alias("lines"))
        line = months.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "lines"))), lambda g: F.concat(F.lit("## "), g["month"], F.lit("\n\n"), g["lines"])), "\n\n").alias("content")).where("content <> ''")
        self._generated("timelines", "timeline", "Timeline", "timeline", line)
        self.changed()

    def _generated(self, folder: str, name: str, title: str, kind: str, body: DataFrame) -> None:
        """One generated page: like any file, it holds its whole text in one row."""
        made = body.select(F.lit(f"{folder}/{name}.md").alias("path"), F.lit(title).alias("title"), F.lit(kind).alias("type"), F.lit(self.today).alias("created"), F.concat(F.lit(f"# {title}\n\n"), "content").alias("content"))
        markdown.write_pages(made, f"{self.root}/wiki")

    def rebuild(self) -> DataFrame:
        """Indexes, graph, state, issues and health, each written; the health is returned."""
        self.indexes()
        out = f"{self.root}/tables"
        markdown.save(graph.nodes(self.pages()), f"{out}/nodes")
        markdown.save(graph.edges(self.pages()), f"{out}/edges")
        neighbours = cut(graph.inlink_chunks(self.pages()))
        markdown.save(neighbours, f"{out}/inlinks")
        full = cut(state.page_state(self.pages(), self.sidecars(), self.files(), neighbours))
        markdown.save(full, f"{out}/state_full")
        markdown.save(state.compact(full), f"{out}/state")
        markdown.save(self.issues(), f"{out}/issues")
        health = cut(state.health(self.issues()))
        markdown.save(health, f"{out}/health")
        self.log("rebuild", "indexes, graph, state and health written")
        return health

    def update_graph(self) -> DataFrame:
        """Takes edits of pages into the stored graph and inlinks; how many pages were parsed and edges made for it."""
        told = Store(self.spark, f"{self.root}/tables/graph").update(markdown.read_files(self.spark, f"{self.root}/wiki"))
        return self.spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))

    def draft(self, rows: DataFrame) -> None:
        markdown.write_pages(rows.withColumn("path", F.concat("dir", F.lit("/"), "stem", F.lit(".md"))), f"{self.root}/wiki")
        self.changed()

    def ask(self, question: str, depth: int = 2, top: int = 5, expand: bool = True) -> DataFrame:
        """The context of a question, kept as the last query for commands to come."""
        found = cut(self.query(question, depth, top, expand))
        kept = found if "section" in found.columns else found.limit(0).select(F.lit(0).cast("long").alias("ord"), F.lit("").alias("stem"), F.lit("").alias("section"))
        asked = self.spark.createDataFrame([(question,)], "question string")
        markdown.save(asked.join(kept.select("ord", "stem", "section"), F.lit(True), "left"), f"{self.root}/tables/last_query")
        return found

    def last_query(self) -> DataFrame:
        """question, ord, stem, section of the last query; empty if there was none."""
        return markdown.read_json(self.spark, f"{self.root}/tables/last_query", LAST_QUERY)

    def save_answer(self, question: str | None, title: str | None, kind: str = "concept", confidence: str = "LOW") -> DataFrame:
        """A draft of the last query's context, or of a question asked now."""
        if question is not None:
            self.ask(question)
        held = cut(self.last_query())
        asked = held.select("question").first()
        if asked is None:
            raise ValueError("nothing was asked so far")
        context = held.where("stem IS NOT NULL").join(self.pages().select("stem", "source_refs"), "stem")
        made = cut(state.saved_answer(context, asked.question, title or asked.question, self.today, kind, confidence))
        self.draft(made)
        return made

    def refine(self) -> DataFrame:
        """What there is to do. Stale pages among it are recorded as checked and stale, and those whose time had come as clean."""
        plan = cut(self.schedule())
        tasks = cut(state.tasks(self.pages(), self.sidecars(), self.files(), plan, self.now))
        results = tasks.where("task_type IN ('stale', 'scheduled_recheck')").groupBy("page").agg(F.max(F.col("task_type") == "stale").alias("stale"))
        markdown.save(recheck.recorded(plan, cut(results), self.now), f"{self.root}/tables/schedule")
        self.log("refine", "tasks listed, checks recorded")
        return tasks

    def recheck(self, only: str | None = None) -> DataFrame:
        """page, bucket of one recheck over all pages, or one; what was due is recorded in the schedule."""
        chosen = P.wiki(self.pages()) if only is None else P.wiki(self.pages()).where(F.col("stem") == only)
        plan = cut(self.schedule())
        done = cut(recheck.run(chosen, plan, self.stale(), self.now))
        results = done.where("bucket <> 'skipped'").select("page", (F.col("bucket") == "stale").alias("stale"))
        markdown.save(recheck.recorded(plan, results, self.now), f"{self.root}/tables/schedule")
        self.log("recheck", "pages rechecked")
        return done


# ---- texts for agents, from the constitution


def instructions(rules_: Constitution) -> str:
    """How pages are to be written, as Markdown."""
    parts = ["# Working with this wiki"]
    for kind in rules_.types():
        fields, sections, own = rules_.fields(kind), rules_.sections(kind), rules_.section_rules(kind)
        parts.append(f"## Pages of type {kind}")
        if fields:
            parts.append("Head: " + ", ".join(fields))
        parts += [f"- {s}" + (f" ({own[s].replace('_', ' ')})" if s in own else "") for s in sections]
    parts.append("## Confidence\n\n" + "\n".join(f"- {k}: {v.get('description', '')}" for k, v in rules_.confidence_levels().items()))
    parts.append("## Relations\n\n" + ", ".join(rules_.relations()) + "; written as [[Page]]:relation.")
    return "\n\n".join(parts) + "\n"


def extraction_prompt(rules_: Constitution, source: str, source_type: str, kind: str = "concept") -> str:
    """What to ask of someone who reads a source."""
    sections = "\n".join(f"- {s}" for s in rules_.sections(kind))
    points = "\n".join(f"- {p}" for p in rules_.template(source_type))
    return f"Read {source} ({source_type}) and write pages of type {kind}, one for each {kind}.\n\nSections:\n{sections}\n\nLook for:\n{points}\n\nHead: {', '.join(rules_.fields(kind))}. Cite each fact as [source: {source}, §section].\n"
