"""The engine's entry points by name: one method per verb, and a dispatcher for tool calls."""

from __future__ import annotations

from collections.abc import Callable
import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lithoscope.functions.text import normalize_dir
from lithoscope.operators import analysis, browse, clones, incremental, knowledge, lint, queues, search
from lithoscope.plans.index import CodeIndex

#: Rules in one prompt; more rules mean more prompts per symbol.
RULES_PER_PROMPT = 1000


class Engine:
    """Queries over a code index folder. `embed` turns a text into a vector; without it search is full-text only."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str], list[float]] | None = None, model: str | None = None):
        self.spark, self.embed, self.model = spark, embed, model
        self.index = CodeIndex(spark, folder)
        self.session, self.knowledge = knowledge.Session(), None

    def _in(self, directory: str = "", excludes: tuple[str, ...] = ()) -> CodeIndex:
        return replace(self.index, directory=normalize_dir(directory), excludes=tuple(excludes))

    def search(self, query: str, n: int = 20, directory: str = "", exts: tuple[str, ...] = (), tags: dict[str, str] | None = None, min_score: float = 0.0, strict: bool = False) -> DataFrame:
        vector = self.embed(query) if self.embed else None
        return search.hybrid_search(self.index, self.index.raw("block_embeddings"), query, vector, max(1, min(50, n)), self.model, tuple(exts), directory, tags, min_score, strict)

    def snippets(self, query: str, directory: str = "", n: int = 10) -> DataFrame:
        """The n best hits with their code, as one text."""
        return search.snippet_search(self.index, self.index.raw("block_embeddings"), query, self.embed(query) if self.embed else None, directory, n, self.model)

    def browse(self, directory: str = "", symbols: bool = False) -> DataFrame:
        ix = self._in(directory)
        return browse.symbol_tree(ix).orderBy("path", "line", "name", "kind", "end_line") if symbols else browse.file_list(ix).orderBy("path")

    def detail(self, name: str, path: str = "") -> DataFrame:
        return browse.detail(self.index, name, path).orderBy("path", "line", "id")

    def show(self, target: str, start: int = 1, end: int = 1 << 30, max_lines: int = 200) -> DataFrame:
        """Lines of a symbol by name, else of the symbols of the file that a path means."""
        ix = self.index
        named = ix.symbols.where(F.col("name") == target)
        if named.limit(1).count() == 0:
            named = ix.symbols.join(ix.paths.join(browse.resolve_files(ix, target), "path", "left_semi").select("file_id").distinct(), "file_id", "left_semi")
        return browse.line_slice(named.where("snippet is not null"), "id", "snippet", F.lit(start), F.lit(end), max_lines).orderBy("id", "line_no")

    def deps(self, directory: str = "") -> DataFrame:
        return browse.adjacency(browse.file_dependencies(self._in(directory)), directory).orderBy("caller")

    def lint(self, directory: str = "", excludes: tuple[str, ...] = (), thresholds: dict[str, int | None] | None = None, suppressions: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
        return lint.lint(self._in(directory, excludes), thresholds, suppressions, min_score)

    def similar(self, directory: str = "", distance: float = 0.1) -> DataFrame:
        ix = self._in(directory)
        return clones.semantic_clusters(ix, ix.raw("block_embeddings"), distance).orderBy("cluster", "path", "line")

    def tags(self, directory: str = "") -> DataFrame:
        return browse.tag_list(self._in(directory)).orderBy("key", "value")

    def findings(self, findings: DataFrame, rules: DataFrame, directory: str = "", **filters) -> DataFrame:
        return browse.findings_report(self._in(directory), findings, rules, **filters)

    def analyze(self, findings: DataFrame, rules: DataFrame, model: Callable[[str], str], directory: str = "", min_lines: int = 0, limit: int = 0, min_confidence: float = 0.5) -> DataFrame:
        """New findings on symbols that have none of the rules' yet, merged into the old ones. All rules are asked about."""
        asked = analysis.pending_symbols(self._in(directory), findings, rules, min_lines, limit)
        listed = [(r["rule_name"], r["severity"]) for r in rules.select("rule_name", "severity").orderBy("rule_name", "severity").collect()]
        blocks = [listed[a : a + RULES_PER_PROMPT] for a in range(0, max(len(listed), 1), RULES_PER_PROMPT)]
        prompts = [asked.select(F.col("id").alias("symbol_id"), analysis.symbol_prompt(b).alias("prompt")) for b in blocks]
        answers = analysis.ask(reduce(DataFrame.unionByName, prompts), "symbol_id", model)
        return analysis.merge_findings(findings, analysis.parse_findings(answers, "symbol_id", rules, min_confidence).withColumn("stale", F.lit(False)))

    def describe(self, model: Callable[[str], str], template: str) -> tuple[DataFrame, DataFrame]:
        """Blocks and symbols with a model's descriptions where they had none."""
        from lithoscope.session import materialise

        answers = materialise(analysis.ask(analysis.description_prompts(self.index, template), "id", model), "descriptions")
        return analysis.apply_descriptions(self.index.blocks, self.index.symbols, answers)

    def embed_missing(self) -> DataFrame:
        """Vectors of the contents that have none yet."""
        return analysis.embed_blocks(self.index, self.index.raw("block_embeddings"), self.model or "", self.embed)

    def knowledge_store(self, concept: str, pattern: str, body: str, source: str = "explicit") -> DataFrame:
        """Add an item to the knowledge at hand (`knowledge`: a DataFrame that the caller sets and keeps)."""
        new = self.spark.createDataFrame([(concept, pattern, body, source)], "concept string, pattern string, body string, source string")
        if self.knowledge is None:
            self.knowledge = self.spark.createDataFrame([], "id bigint, concept string, pattern string, body string, source string, created_at bigint, surfaced_count bigint, suppressed_at bigint")
        self.knowledge = knowledge.store(self.knowledge, new, F.unix_timestamp())
        return new

    def knowledge_session_reset(self) -> DataFrame:
        self.session.reset()
        return self.spark.createDataFrame([("hint session reset",)], "message string")

    def summary(self, directory: str = "") -> DataFrame:
        ix = self._in(directory)
        return browse.summary(ix, ix.raw("block_embeddings"))

    def status(self, heartbeats: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
        return queues.latest_status(heartbeats), queues.queue_eta(history)

    def rescan(self, directory: str = "", exts: tuple[str, ...] = ()) -> DataFrame:
        return incremental.rescan(self.index.paths, normalize_dir(directory), tuple(exts), 10)

    def reindex(self, directory: str = "", exts: tuple[str, ...] = ()) -> DataFrame:
        return incremental.rescan(self.index.paths, normalize_dir(directory), tuple(exts), 2)

    def purge(self, roots: DataFrame | None = None, present: DataFrame | None = None, worktrees: DataFrame | None = None, rules: DataFrame | None = None, dry_run: bool = True) -> DataFrame | dict[str, DataFrame]:
        """`path, reason` of what would go; without `dry_run` the index that is left.

        roots(dir): explicit; present(path): all others are missing; worktrees(dir):
        nested work trees; rules(dir, line): ignore rules.
        """
        ix = self.index
        gone = incremental.purge_reasons(ix.paths, roots, present, worktrees, rules)
        if dry_run:
            return gone
        return incremental.cascade({"file_paths": ix.paths, "files": ix.files, "symbols": ix.symbols, "code_blocks": ix.blocks, "symbol_refs": ix.refs, "external_refs": ix.external}, gone)


#: The tools and the names of their arguments; those with a star are needed.
TOOLS = {
    "search": "*query n directory exts tags min_score strict", "browse": "directory symbols", "detail": "*name path", "deps": "directory", "show": "*target start end max_lines",
    "tags": "directory", "summary": "directory", "knowledge_store": "*concept *pattern *body source", "knowledge_session_reset": "",
}
PROTOCOL = "2024-11-05"


def tool_list() -> list[dict]:
    out = []
    for name, arguments in TOOLS.items():
        names = arguments.split()
        schema = {"type": "object", "properties": {a.lstrip("*"): {} for a in names}, "required": [a[1:] for a in names if a[0] == "*"]}
        out.append({"name": name, "description": (getattr(Engine, name).__doc__ or name).strip().split("\n")[0], "inputSchema": schema})
    return out


def serve_line(engine: Engine, line: str) -> str | None:
    """The reply to one line of input; None for notifications and blank lines."""
    if not line.strip():
        return None
    try:
        request = json.loads(line)
    except json.JSONDecodeError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
    reply = call_tool(engine, request)
    return None if reply is None else json.dumps(reply, default=str)


def call_tool(engine: Engine, request: dict, max_rows: int = 200) -> dict | None:
    """Answer one JSON-RPC 2.0 request: `initialize`, `tools/list`, or `tools/call` with a tool's name and arguments.

    A reply has at most `max_rows` rows, from the parameter `offset` (0) on; `truncated`
    says whether more follow, which a call with a larger offset gives. A request without
    an id and of another method is a notification: it has no reply.
    """
    if not isinstance(request, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lithoscope", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": tool_list()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"method not found: {method}"}} if "id" in request else None
    try:
        if params.get("name") not in TOOLS:
            return reply | {"error": {"code": -32601, "message": "unknown tool"}}
        offset = params.get("offset", 0)
        if type(offset) is not int or offset < 0:
            return reply | {"error": {"code": -32602, "message": "offset must be a whole number from 0 on"}}
        rows = getattr(engine, params["name"])(**(params.get("arguments") or {})).offset(offset).limit(max_rows + 1).collect()
        return reply | {"result": {"rows": [r.asDict(recursive=True) for r in rows[:max_rows]], "offset": offset, "truncated": len(rows) > max_rows}}
    except (TypeError, KeyError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}
    except Exception as e:  # noqa: BLE001 - one failed call must not end the server
        return reply | {"error": {"code": -32603, "message": str(e)[:500]}}
