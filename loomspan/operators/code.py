"""Extraction of symbols, routes, imports, entrypoints, comments and call edges from the line table.

A language is a set of line rules. All rules of a language are columns over one pass of its lines, to
which the span operators have added block ends and annotations; a line's nodes are exploded from an
array. Scopes then meet call tokens in one interval join by file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import graph, spans
from loomspan.sources.scratch import written

FILE = ["repo_name", "file_path"]
NODE = "array<struct<node_type:string,symbol:string,start_line:int,end_line:int,confidence:double,kind:string,metadata:map<string,string>>>"


def node(kind: str | Column, symbol: Column, start: Column, stop: Column, confidence: float | Column, detail: str | Column = "", **metadata: Column) -> Column:
    """A node; entries of ``metadata`` that are null are left out."""
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in metadata.items()]) if metadata else F.array().cast("array<struct<key:string,value:string>>")
    meta = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.struct(lit(kind).alias("node_type"), symbol.alias("symbol"), start.cast("int").alias("start_line"), stop.cast("int").alias("end_line"), lit(confidence).alias("confidence"), lit(detail).alias("kind"), meta.alias("metadata"))


def _hit(pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.nullif(F.regexp_extract("line", "(?U)" + pattern, group), F.lit(""))


@dataclass(frozen=True)
class Language:
    """Fixed patterns of a language's lines and what they stand for."""

    comment: str
    types: list[tuple[str, int]] = field(default_factory=list)  # pattern, symbol group
    functions: list[tuple[str, int]] = field(default_factory=list)
    imports: list[tuple[str, str, float]] = field(default_factory=list)  # pattern, kind, confidence
    annotation: str = ""  # prefix; symbols start at their annotations
    annotated: str = "all"  # or "types": functions start at their own line
    annotations_name: str = "annotations"
    routes: Callable[[Column, Column], Column] | None = None  # (symbol, annotations) -> route symbol or null
    line_routes: Callable[[], Column] | None = None
    entries: list[tuple[str, str, str, float]] = field(default_factory=list)  # pattern, symbol, kind, confidence
    main: tuple[str, str, float] | None = None  # function name, kind, confidence
    any_case_main: bool = False
    type_entry: tuple[str, str, float] | None = None  # pattern of a type's line, kind, confidence; the symbol is the type's
    kind_name: str = ""  # metadata key of the word that declares a type
    kinds: str = ""  # pattern of that word
    frameworks: tuple[tuple[str, str], ...] = ()  # pattern of an annotation, framework
    file_framework: tuple[str, str] | None = None  # pattern anywhere in a file, framework of its classes
    declaration_confidence: float | None = None  # of a function whose line ends in ';' (group 2 of the pattern)
    function_confidence: float = 1.0
    type_confidence: float = 1.0
    skip: tuple[str, ...] = ("if", "for", "while", "switch", "catch", "return")
    block_import: tuple[str, str, str, str, float] | None = None  # opening line, closing line, pattern, kind, confidence
    object_routes: tuple[str, str] | None = None  # pattern of a route, pattern that a file with such routes has
    component: str = ""  # pattern anywhere in a file that makes capitalised symbols components


def _mapping_route(pattern: str) -> Callable[[Column, Column], Column]:
    def route(symbol: Column, anns: Column) -> Column:
        mapped = F.filter(anns, lambda a: F.regexp(a, F.lit(pattern)))
        path = spans.annotation_path(mapped)
        return F.when(F.size(mapped) > 0, F.concat(symbol, F.lit(":"), F.when(path == "", "unknown").otherwise(path)))

    return route


_SPRING = r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\b"

_CS_MODIFIER = r"(?:public|private|protected|internal|static|virtual|override|async|sealed|new|partial)\s++(?!\()"

# The patterns that define each language's nodes. Java's matcher calls itself once a turn of a group
# that may give back what it took, so groups that repeat are possessive, and a word before a bracket is kept from them
# by a look ahead: a line of any length needs no stack, and time in proportion to it.
LANGUAGES: dict[str, Language] = {
    "javascript": Language(
        comment="//", annotation="@", annotated="types", annotations_name="decorators", any_case_main=True, file_framework=(r"""@(?:Component|Injectable|NgModule|Directive|Pipe)\b|from\s+["']@angular""", "angular"),
        types=[(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_]\w*)", 1)],
        functions=[
            (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\(", 1),
            (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>", 1),
            (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?function\b", 1),
        ],
        imports=[
            (r"""^\s*+import\s[^;]*?\sfrom\s++["']([^"']+)["']""", "import_from", 0.8),
            (r"""^\s*import\s+["']([^"']+)["']""", "import_side_effect", 0.8),
            (r"""require\s*\(\s*["']([^"']+)["']\s*\)""", "require", 0.78),
        ],
        line_routes=lambda: _hit(r"""<Route[^>]*\bpath=["']([^"']+)["']"""),
        entries=[(r"\b((?:app|server|httpServer)\.listen)\s*\(", "listen", "server_start", 0.86), (r"\b(ReactDOM\.render|createRoot)\s*\(", "ui_bootstrap", "ui_bootstrap", 0.82)],
        object_routes=(r"""\bpath\s*:\s*["']([^"']+)["']""", r"(?i:routes)|RouterModule"),
        main=("main", "main_function", 0.86),
        component=r"""from\s+["']react["']|require\(["']react["']\)""",
    ),
    "java": Language(
        comment="//", annotation="@",
        types=[(r"^\s*+(?:public|protected|private)?+\s*+(?:abstract\s++|final\s++)?+(?:class|interface|enum|record)\s++([A-Za-z_]\w*)", 1)],
        functions=[(r"^(?:\s*+(?:public|protected|private)?+\s*+(?:static\s++)?+(?:final\s++)?+(?:synchronized\s++)?+<[^>]++>)?[\w\[\]<>?,\s]{2,}(?<=\s)([A-Za-z_]\w*+)\s*+\([^;]*\)\s*+(?:throws\s+[^{]+)?\{", 1)],
        imports=[(r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;", "import", 0.8)],
        routes=_mapping_route(_SPRING),
        entries=[(r"^(?=.*\sstatic\s).*\b(main)\s*+\([^;]*\)\s*+(?:throws\s+[^{]+)?\{", "main", "jvm_main", 0.88)],
    ),
    "kotlin": Language(
        comment="//", annotation="@",
        types=[(r"^\s*+(?:(?:public|private|protected|internal|open|abstract|sealed|final|data|enum|annotation)\s++)*+(?:class|interface|object|enum\s+class|sealed\s+class|data\s+class)\s+([A-Za-z_]\w*)", 1)],
        functions=[(r"^\s*+(?:(?:public|private|protected|internal|open|abstract|final|suspend|inline|tailrec|operator|infix|external|override)\s++)*+fun\s+([A-Za-z_]\w*)\s*\(", 1)],
        imports=[(r"^\s*import\s+([A-Za-z0-9_.*]+)\s*$", "import", 0.8)],
        routes=_mapping_route(_SPRING),
        line_routes=lambda: _hit(r"""\b(?:get|post|put|delete|patch|route)\s*\(\s*["']([^"']+)["']"""),
        type_entry=(r"^\s*+(?:(?:public|private|protected|internal|open|abstract|sealed|final|data|enum|annotation)\s++)*+object\s.*:\s*App\b", "kotlin_app_object", 0.86),
        kind_name="kotlin_kind", kinds=r"\b(class|interface|object)\s", frameworks=((r"@(?:RestController|Controller|Service)", "spring-boot"),),
        main=("main", "kotlin_main", 0.88), function_confidence=0.88, type_confidence=0.9,
    ),
    "go": Language(
        comment="//",
        types=[(r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", 1)],
        functions=[(r"^\s*func\s*(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(", 1)],
        imports=[(r"""^\s*import\s+(?:[A-Za-z_]\w*\s+)?"([^"]+)\"""", "import_single", 0.8)],
        block_import=(r"^\s*import\s*\(\s*$", r"^\s*\)", r"""^\s*(?:[A-Za-z_]\w*\s+)?"([^"]+)\"""", "import_block", 0.8),
        line_routes=lambda: F.concat(F.upper(_hit(r"""\.(GET|POST|PUT|DELETE|PATCH|Handle|HandleFunc)\s*\(\s*"([^"]+)\"""")), F.lit(":"), _hit(r"""\.(GET|POST|PUT|DELETE|PATCH|Handle|HandleFunc)\s*\(\s*"([^"]+)\"""", 2)),
        entries=[(r"\b((?:http\.)?ListenAndServe)\s*\(", "ListenAndServe", "server_start", 0.86)],
        main=("main", "go_main", 0.9), function_confidence=0.88, type_confidence=0.86, kind_name="go_kind", kinds=r"\b(struct|interface)\b",
    ),
    "csharp": Language(
        comment="//", annotation="[",
        types=[(r"^\s*+(?:(?:public|private|protected|internal|sealed|abstract|partial|static)\s++)*+(?:class|interface|struct|record)\s+([A-Za-z_]\w*)", 1)],
        functions=[(rf"^\s*+{_CS_MODIFIER}(?:(?:{_CS_MODIFIER})++(?:[\w<>,\[\]\.\?]++\s++)?|[\w<>,\[\]\.\?]++\s++)([A-Za-z_]\w*+)\s*+\([^;]*\)\s*+(?:where\s+[^{{]+)?\{{", 1)],
        imports=[(r"^\s*using\s+([A-Za-z0-9_.]+)\s*;", "using", 0.8)],
        routes=_mapping_route(r"\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\b"),
        entries=[(r"^(?=.*\bstatic\s).*\b(Main)\s*+\([^;]*\)\s*+\{", "Main", "dotnet_main", 0.9)],
    ),
    "cpp": Language(
        comment="//",
        types=[(r"^\s*+(?:template\s*+<[^>]++>\s*+)?(?:class|struct)\s++([A-Za-z_]\w*)", 1)],
        functions=[(r"^\s*+(?:template\s*+<[^>]++>\s*+)?(?:[\w:<>~*&]++\s++(?!\())++([A-Za-z_~]\w*+(?:::[A-Za-z_~]\w*+)?)\s*+\([^;{}]*\)\s*+(?:const\s*+)?(?:noexcept\s*+)?(?:override\s*+)?(?:final\s*+)?(\{|;)", 1)],
        imports=[(r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""", "include", 0.78)],
        main=("main", "cpp_main", 0.9), function_confidence=0.8, type_confidence=0.88, declaration_confidence=0.65,
    ),
    "scala": Language(
        comment="//",
        types=[(r"^\s*+(?:(?:sealed|final|abstract|case|private|protected)\s++)*+(?:class|object|trait)\s+([A-Za-z_]\w*)", 1)],
        functions=[(r"^\s*+(?:(?:override|private|protected|implicit|final)\s++)*+def\s+([A-Za-z_]\w*)\b", 1)],
        imports=[(r"^\s*+import\s++([A-Za-z0-9_.*{} ,]++)\s*+$", "import", 0.8)],
        type_entry=(r"^\s*+(?:(?:sealed|final|abstract|case|private|protected)\s++)*+object\s.*extends App", "scala_app_object", 0.86),
        kind_name="scala_kind", kinds=r"\b(class|object|trait)\s",
        main=("main", "scala_main", 0.9), function_confidence=0.88, type_confidence=0.9,
    ),
    "r": Language(
        comment="#",
        types=[(r"""setClass\(\s*["']([A-Za-z_]\w*)["']""", 1)],
        functions=[(r"^\s*([A-Za-z_]\w*)\s*(?:<-|=)\s*function\s*\(", 1)],
        imports=[(r"""\b(?:library|require)\s*\(\s*["']?([A-Za-z0-9_.]+)["']?\s*\)""", "library", 0.78)],
        main=("main", "r_main_function", 0.82), function_confidence=0.88, type_confidence=0.82,
    ),
}
LANGUAGES["typescript"] = LANGUAGES["javascript"]


def _import_node(module: Column, line: Column, confidence: float, kind: str) -> Column:
    return node("import_usage", T.strip(module), line, line, confidence, kind)


def _import_nodes(modules: Column, line: Column, confidence: float, kind: str) -> Column:
    return F.transform(modules, lambda m: _import_node(m, line, confidence, kind)).cast(NODE)


def extract(lines: DataFrame, language: str) -> DataFrame:
    """``(file, node_type, symbol, start_line, end_line, confidence, kind, metadata)`` of one language's lines.

    Of nodes alike in file, type, symbol and lines, the one of the earlier rule stays.
    """
    rules = LANGUAGES[language]
    rows = spans.brace_blocks(lines)
    here, has_block = F.col("line_no"), F.contains("line", F.lit("{"))
    t_start = f_start = here
    anns = F.lit(None).cast("string")
    if rules.annotation:
        rows = spans.annotation_blocks(rows, rules.annotation)
        t_start = F.col("ann_start")
        f_start = here if rules.annotated == "types" else t_start
        anns = F.nullif(F.array_join("annotations", "\n"), F.lit(""))
    whole_file = Window.partitionBy(*FILE)
    if rules.component:
        rows = rows.withColumn("ui", F.max(F.col("line").rlike(rules.component)).over(whole_file) | F.col("file_path").rlike(r"(?i)\.[jt]sx$"))
    if rules.file_framework:
        rows = rows.withColumn("file_framework", F.when(F.max(F.col("line").rlike(rules.file_framework[0])).over(whole_file), rules.file_framework[1]))
    rows = rows.withColumn("t_sym", F.coalesce(*[_hit(p, g) for p, g in rules.types]))
    rows = rows.withColumn("f_sym", F.when(F.col("t_sym").isNull(), F.coalesce(*[_hit(p, g) for p, g in rules.functions])))
    rows = rows.withColumn("f_sym", F.when(~F.col("f_sym").isin(*rules.skip), F.col("f_sym")))
    t_sym, f_sym = F.col("t_sym"), F.col("f_sym")
    end = F.when(has_block, F.col("block_end")).otherwise(here)
    if language == "r":
        rows = spans.statement_ends(rows)
    upper = lambda sym: F.col("ui") & F.substring(sym, 1, 1).rlike("[A-Z]") if rules.component else F.lit(False)
    kind_of = lambda plain, sym: F.when(upper(sym), "component").otherwise(plain)
    by_annotation = [F.when(F.col("ann_text").rlike(p), name) for p, name in rules.frameworks]
    rows = rows.withColumn("ann_text", anns)
    framework = F.coalesce(*by_annotation, F.col("file_framework") if rules.file_framework else F.lit(None).cast("string"))
    t_meta = {rules.annotations_name: F.col("ann_text"), "framework": framework}
    if rules.kind_name:
        t_meta[rules.kind_name] = _hit(rules.kinds)
    f_meta = {} if rules.annotated == "types" else {rules.annotations_name: F.col("ann_text")}
    if rules.component:
        f_meta["framework"] = F.when(upper(f_sym), "react")
    f_confidence, f_end = F.lit(rules.function_confidence), end
    if rules.declaration_confidence is not None:
        rows = rows.withColumn("declares", F.coalesce(*[_hit(p, 2) for p, _ in rules.functions]) == ";")
        declares = F.col("declares")
        f_meta["declaration"] = declares
        f_confidence, f_end = F.when(declares, rules.declaration_confidence).otherwise(f_confidence), F.when(declares, here).otherwise(end)
    made = [
        F.when(t_sym.isNotNull(), node(kind_of("class", t_sym), t_sym, t_start, F.col("statement_end") if language == "r" else end, rules.type_confidence, **t_meta)),
        F.when(f_sym.isNotNull(), node(kind_of("function", f_sym), f_sym, f_start, f_end, f_confidence, **f_meta)),
    ]
    if rules.type_entry:
        pattern, kind, confidence = rules.type_entry
        made.append(F.when(t_sym.isNotNull() & F.regexp("line", F.lit("(?U)" + pattern)), node("entrypoint", t_sym, here, here, confidence, kind)))
    if rules.routes:
        rows = rows.withColumn("mapped", rules.routes(f_sym, F.col("annotations")))
        path = F.col("mapped")
        made.append(F.when(f_sym.isNotNull() & path.isNotNull(), node("route", path, f_start, end, 0.88, **f_meta)))
    if rules.line_routes:
        rows = rows.withColumn("routed", rules.line_routes())
        path = F.col("routed")
        made.append(F.when(t_sym.isNull() & path.isNotNull(), node("route", path, here, here, 0.8, framework=F.lit("react" if rules.object_routes else None).cast("string"))))
    if rules.object_routes:
        pattern, needs = rules.object_routes
        rows = rows.withColumn("has_routes", F.max(F.col("line").rlike(needs)).over(whole_file))
        rows = rows.withColumn("object_path", F.when(F.col("has_routes") & F.col("routed").isNull(), _hit(pattern)))
        path = F.col("object_path")
        made.append(F.when(t_sym.isNull() & path.isNotNull(), node("route", path, here, here, 0.8, framework=F.coalesce("file_framework", F.lit("router")))))
    if rules.block_import:
        opens, closes, pattern, kind, confidence = rules.block_import
        mark = F.when(F.col("line").rlike(opens), True).when(F.col("line").rlike(closes), False)
        rows = rows.withColumn("in_block", F.coalesce(F.last(mark, ignorenulls=True).over(spans.by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
        rows = rows.withColumn("block_module", F.when(F.col("in_block"), _hit(pattern)))
        made.append(F.when(F.col("block_module").isNotNull(), node("import_usage", F.col("block_module"), here, here, confidence, kind)))
    if rules.main:
        name, kind, confidence = rules.main
        called = F.element_at(F.split(f_sym, "::"), -1)
        made.append(F.when((F.lower(called) if rules.any_case_main else called) == name, node("entrypoint", f_sym, here, here, confidence, kind)))
    made += [F.when(t_sym.isNull() & _hit(p).isNotNull(), node("entrypoint", F.lit(s), here, here, c, k)) for p, s, k, c in rules.entries]
    several = []  # a pattern that may stand anywhere in a line counts as often as it does
    for i, (pattern, kind, confidence) in enumerate(rules.imports):
        if pattern.startswith("^"):
            rows = rows.withColumn(f"module_{i}", _hit(pattern))
            made.append(F.when(F.col(f"module_{i}").isNotNull(), _import_node(F.col(f"module_{i}"), here, confidence, kind)))
        else:
            several.append((pattern, kind, confidence))
    listed = F.array(*made).cast(NODE)
    for pattern, kind, confidence in several:
        found = F.regexp_extract_all("line", F.lit("(?U)" + pattern), F.lit(1))
        listed = F.concat(listed, _import_nodes(found, here, confidence, kind))
    found = written(rows.select(*FILE, F.posexplode(listed).alias("seq", "n")).where("n IS NOT NULL").select(*FILE, "seq", "n.*"), "found")  # nodes and scopes read it
    comments = spans.hash_comments(lines).withColumn("kind", F.lit("line_block")) if rules.comment == "#" else spans.marked_comments(lines, rules.comment)
    named = F.when(F.col("kind") == "block", "comment_block").otherwise("comment_line")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    comments = comments.select(*FILE, F.lit(0).alias("seq"), named.alias("node_type"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", F.lit(0.78).alias("confidence"), "kind", none.alias("metadata"))
    scopes = found.where(F.col("node_type").isin("function", "class", "component"))
    calls = graph.scoped_calls(scopes, graph.call_tokens(lines))
    edges = graph.edge_nodes(calls, F.lit(language))
    ends = F.create_map(F.lit("relation"), F.lit("calls"), F.lit("caller"), F.split_part("symbol", F.lit("->"), F.lit(1)), F.lit("callee"), F.split_part("symbol", F.lit("->"), F.lit(2)))
    edges = edges.select(*FILE, F.lit(0).alias("seq"), "node_type", "symbol", "start_line", "end_line", "confidence", F.lit("calls").alias("kind"), ends.alias("metadata"))
    every = found.unionByName(comments).unionByName(edges)
    first = every.groupBy(*FILE, "node_type", "symbol", "start_line", "end_line").agg(F.min_by(F.struct("confidence", "kind", "metadata"), "seq").alias("n"))
    return first.select(*FILE, "node_type", "symbol", "start_line", "end_line", "n.*", F.lit(language).alias("language"))


def sql_lineage(lines: DataFrame) -> DataFrame:
    """Tables, views, routines, statements, and edges from their callers to the tables and routines they name."""
    # The patterns below define statements, names and references.
    name = r"([A-Za-z0-9_.$\"`\[\]]+)"
    rows = spans.statement_ends(lines)
    grab = lambda p, g=1: F.nullif(F.regexp_extract("line", "(?i)" + p, g), F.lit(""))
    create = r"^\s*create\s+(?:or\s+replace\s+)?"
    table, view, proc = grab(create + r"table\s+" + name), grab(create + r"view\s+" + name), grab(create + r"(?:procedure|proc|function)\s+" + name)
    stmt = grab(r"^\s*(select\b|with\b|insert\s+into\b|update\b|delete\s+from\b|merge\s+into\b)")
    here, stop = F.col("line_no"), F.col("statement_end")
    op = F.upper(F.regexp_extract(stmt, r"^(\w+)", 1))
    made = F.when(table.isNotNull(), node("table", T.clean_sql_name(table), here, stop, 0.9, "create_table")).when(view.isNotNull(), node("view", T.clean_sql_name(view), here, stop, 0.9, "create_view"))
    made = made.when(proc.isNotNull(), node("function", T.clean_sql_name(proc), here, stop, 0.9, "routine")).when(stmt.isNotNull(), node("query", F.concat(op, F.lit("@"), here.cast("string")), here, stop, 0.82, op))
    found = rows.withColumn("n", made).where(F.col("n").isNotNull()).select(*FILE, "n.*")
    ref = lambda p: F.transform(F.regexp_extract_all("line", F.lit("(?i)" + p + name), F.lit(1)), T.clean_sql_name)
    refs = F.concat(F.transform(ref(r"\b(?:from|join|into|update|merge\s+into)\s+"), lambda x: F.struct(x.alias("callee"), F.lit(0.74).alias("c"))), F.transform(ref(r"\b(?:call|exec(?:ute)?)\s+"), lambda x: F.struct(x.alias("callee"), F.lit(0.76).alias("c"))))
    uses = lines.select(*FILE, "line_no", F.explode(refs).alias("r")).select(*FILE, "line_no", "r.*").where(F.col("callee") != "")
    scopes = found.where(F.col("node_type") == "function").select(*FILE, F.col("symbol").alias("owner"), "start_line", "end_line")
    covered = graph.within(scopes, uses.select(*FILE, "line_no").distinct(), F.col("start_line"), F.col("end_line"))
    owner = covered.groupBy(*FILE, "line_no").agg(F.min_by("owner", "start_line").alias("owner"))
    edges = uses.join(owner, [*FILE, "line_no"], "left").withColumn("caller", F.coalesce("owner", F.concat(F.lit("query@"), F.col("line_no").cast("string"))))
    edges = edges.groupBy(*FILE, F.concat("caller", F.lit("->"), "callee").alias("symbol"), "line_no").agg(F.min("c").alias("confidence"))
    edges = edges.select(*FILE, F.lit("call_edge").alias("node_type"), "symbol", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), "confidence", F.lit("references").alias("kind"))
    comments = spans.marked_comments(lines, "--")
    named = F.when(F.col("kind") == "block", "comment_block").otherwise("comment_line")
    comments = comments.select(*FILE, named.alias("node_type"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", F.lit(0.78).alias("confidence"), "kind")
    every = found.unionByName(edges, allowMissingColumns=True).unionByName(comments, allowMissingColumns=True)
    return every.withColumns({"metadata": F.coalesce("metadata", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))), "language": F.lit("sql")})


# Division and paragraph names that are no labels.
COBOL_RESERVED = ["IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE", "WORKING-STORAGE", "FILE", "LINKAGE", "CONFIGURATION", "INPUT-OUTPUT"]


def cobol(lines: DataFrame) -> DataFrame:
    """Programs, sections, paragraphs, and CALL edges owned by the latest label."""
    # The patterns of programs, sections, paragraphs and calls.
    program = F.nullif(F.regexp_extract("line", r"(?i)^\s*PROGRAM-ID\.\s*([A-Za-z0-9_-]+)\.?", 1), F.lit(""))
    section = F.nullif(F.regexp_extract("line", r"(?i)^\s*([A-Za-z0-9-]+)\s+SECTION\.\s*$", 1), F.lit(""))
    para = F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z0-9-]+)\.\s*$", 1), F.lit(""))
    para = F.when(~F.upper(para).isin(COBOL_RESERVED), para)
    n = F.max("line_no").over(Window.partitionBy(*FILE))
    rows = lines.withColumns({"program": program, "label": F.when(program.isNull(), F.coalesce(section, para)), "is_section": section.isNotNull(), "n_lines": n})
    rows = rows.withColumn("owner", F.last(F.coalesce("program", "label"), ignorenulls=True).over(spans.by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    here = F.col("line_no")
    label = lambda kind, c: node("function", F.col("label"), here, F.least(here + 1, F.col("n_lines")), c, kind)
    made = F.when(F.col("program").isNotNull(), node("class", F.col("program"), here, here, 0.84, "program")).when(F.col("label").isNotNull() & F.col("is_section"), label("section", 0.78)).when(F.col("label").isNotNull(), label("paragraph", 0.72))
    found = rows.withColumn("n", made).where(F.col("n").isNotNull()).select(*FILE, "n.*")
    calls = rows.where(F.col("program").isNull() & ~F.col("is_section") & F.col("owner").isNotNull()).select(*FILE, "owner", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(?i)\bCALL\s+['\"]?([A-Za-z0-9_-]+)"), F.lit(1))).alias("callee"))
    edges = calls.select(*FILE, F.lit("call_edge").alias("node_type"), F.concat("owner", F.lit("->"), "callee").alias("symbol"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.lit(0.76).alias("confidence"), F.lit("calls").alias("kind")).distinct()
    comments = spans.cobol_comments(lines).select(*FILE, F.lit("comment_line").alias("node_type"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", F.lit(0.78).alias("confidence"), F.lit("line_block").alias("kind"))
    every = found.unionByName(edges, allowMissingColumns=True).unionByName(comments, allowMissingColumns=True)
    return every.withColumns({"metadata": F.coalesce("metadata", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))), "language": F.lit("cobol")})


NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:string,execution_count:int,metadata:struct<language:string>>>,metadata:struct<language_info:struct<name:string>>>"


def notebook_error(text: Column) -> Column:
    """Why a text is no notebook: it is no JSON, or its root is no object; null if it is one."""
    return F.when(F.try_parse_json(text).isNull(), "invalid_ipynb").when(~F.startswith(T.strip(text), F.lit("{")), "invalid_ipynb_root")


def notebook_cells(files: DataFrame) -> DataFrame:
    """``(file, cell_index, cell_type, language, execution_count, start_line, n_lines, source, parse_error)``: cells laid one after another with a blank line between.

    An empty cell is one empty line. A text that is no JSON, or whose root is no object, gives one row with ``parse_error`` and
    no cell; a notebook without cells gives none.
    """
    nb = files.select(*FILE, F.from_json("text", NOTEBOOK).alias("nb"), notebook_error(F.col("text")).alias("error"))
    none = lambda t: F.lit(None).cast(t)
    error = F.col("error")
    bad = nb.where(error.isNotNull()).select(*FILE, F.lit(-1).alias("cell_index"), none("string").alias("cell_type"), none("string").alias("language"), none("int").alias("execution_count"), F.lit(1).alias("start_line"), F.lit(0).alias("n_lines"), F.lit("").alias("source"), error.alias("parse_error"))
    cells = nb.where(error.isNull()).select(*FILE, F.col("nb.metadata.language_info.name").alias("nb_lang"), F.posexplode("nb.cells").alias("cell_index", "c")).where("c IS NOT NULL")
    listed = F.array_join(F.from_json("c.source", "array<string>"), "")
    cells = cells.withColumn("source", F.coalesce(F.when(F.startswith("c.source", F.lit("[")), listed), "c.source", F.lit("")))
    cells = cells.withColumn("n_lines", F.greatest(F.lit(1), F.size(T.split_lines(F.col("source")))))
    start = F.coalesce(F.sum(F.col("n_lines") + 1).over(Window.partitionBy(*FILE).orderBy("cell_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    lang = F.coalesce(F.nullif(F.lower(T.strip(F.col("c.metadata.language"))), F.lit("")), F.nullif(F.lower(T.strip(F.col("nb_lang"))), F.lit("")), F.lit("python"))
    kind = F.lower(T.strip(F.coalesce("c.cell_type", F.lit("unknown"))))
    good = cells.select(*FILE, "cell_index", kind.alias("cell_type"), lang.alias("language"), F.col("c.execution_count").alias("execution_count"), start.cast("int").alias("start_line"), "n_lines", "source", none("string").alias("parse_error"))
    return good.unionByName(bad)
