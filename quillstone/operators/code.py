"""Analytics over source lines (file, line_no, line): definitions, calls, reachability, patterns, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once
from ..session import kept
from .graph import reachable

#: A function definition with its qualifiers; words that look like calls and are none; fixed values.
DEFINITION = r'^\s*((?:pub|pub\(crate\)|pub\(super\)|async|unsafe|const|extern|"C")\s+)*fn ([A-Za-z0-9_]{2,})[^A-Za-z0-9_]'
NOISE = (
    "if", "for", "while", "match", "return", "let", "Some", "None", "Ok", "Err", "Box", "Vec", "String", "format", "write", "writeln", "println", "eprintln",
    "assert", "assert_eq", "panic", "todo", "fn", "pub", "use", "mod", "impl", "self", "as", "in", "unsafe", "async", "move", "type", "where", "mut", "ref", "true", "false",
)
#: (text, kind) that costs time; fixed values.
COSTS = (
    ("Vec::new", "ALLOC"), ("Vec::with_capacity", "ALLOC"), ("String::new", "ALLOC"), ("String::with_capacity", "ALLOC"), (".to_string()", "ALLOC"), (".to_vec()", "ALLOC"),
    ("Box::new", "ALLOC"), ("format!", "FORMAT"), (".clone()", "CLONE"), (".to_owned()", "CLONE"), ("std::fs::read", "SYSCALL"), ("std::fs::write", "SYSCALL"), ("fs::read", "SYSCALL"),
    ("fs::write", "SYSCALL"), ("read_to_string", "SYSCALL"), ("read_dir", "SYSCALL"), ("OpenOptions", "SYSCALL"), (".lock()", "LOCK"), (".read()", "LOCK"), (".write()", "LOCK"),
    ("println!", "FORMAT"), ("eprintln!", "FORMAT"), ("writeln!", "FORMAT"), ("write!", "FORMAT"),
)
#: Names of a numbered backtrace that belong to the runtime; fixed values.
RUNTIME = ("main", "call_once", "call", "invoke", "start_thread", "clone", "drop", "deref", "fmt", "write", "read", "poll", "resume", "catch_unwind", "panic", "begin_panic")


def source_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, line_no, line) of a tree's files with a suffix; hidden folders, target and node_modules are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    base = rows.where(~F.regexp_replace("file", f"^.*?{path.rstrip('/')}/", "").rlike(r"(^|/)(\.[^/]*|target|node_modules)/"))
    return base.select("file", (F.col("i") + 1).alias("line_no"), "line")


def functions(lines: DataFrame) -> DataFrame:
    """(file, name, line_no, end_line, is_pub): a function ends where the next begins, or with the file."""
    size = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    d = lines.where(~F.trim("line").startswith("//") & F.col("line").rlike(DEFINITION))
    d = d.select("file", F.regexp_extract("line", DEFINITION, 2).alias("name"), "line_no", F.col("line").rlike(r"^\s*pub\b").alias("is_pub")).join(size, "file")
    return d.withColumn("end_line", F.coalesce(F.lead("line_no").over(Window.partitionBy("file").orderBy("line_no")) - 1, F.col("n"))).drop("n")


def marked(lines: DataFrame, costly: bool = False) -> DataFrame:
    """(file, line_no, own, is_pub, callees, name) of lines that define or call: the function that they define,
    the names that they call, and the function that they stand in (null before a file's first); if costly, also
    lines that cost, with kinds. A line is read once and its text goes no further than the scan, so the window
    over a file sorts narrow rows."""
    plain, line = ~F.trim("line").startswith("//"), F.col("line")
    own = F.when(plain & line.contains("fn "), F.nullif(F.regexp_extract(line, DEFINITION, 2), F.lit("")))
    # from the beginning of a word only, and without going back in it
    callees = F.when(plain & line.contains("("), F.array_distinct(F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]{2,}+)\("), F.lit(1))))
    kinds = F.when(plain, F.filter(F.array(*(F.when(line.contains(p), k) for p, k in COSTS)), lambda x: x.isNotNull()))
    more = [once(kinds).alias("kinds")] if costly else []
    rows = lines.select("file", "line_no", once(own).alias("own"), line.rlike(r"^\s*pub\b").alias("is_pub"), once(callees).alias("callees"), *more)
    rows = rows.withColumn("callees", F.filter("callees", lambda x: ~x.isin(*NOISE) & (F.coalesce("own", F.lit("")) != x)))
    rows = rows.where(F.col("own").isNotNull() | (F.size("callees") > 0) | (F.size("kinds") > 0 if costly else F.lit(False)))
    return rows.withColumn("name", F.last("own", True).over(Window.partitionBy("file").orderBy("line_no")))


def _called(marks: DataFrame) -> DataFrame:
    """(file, line_no, caller, callee) of marked lines."""
    return marks.select("file", "line_no", F.coalesce("name", F.lit("<module>")).alias("caller"), F.explode("callees").alias("callee"))


def calls(lines: DataFrame) -> DataFrame:
    """(file, line_no, caller, callee): names before a bracket, and the function that they stand in."""
    return _called(marked(lines))


def callers(lines: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """(name, depth) of what calls `name`, directly or over up to three steps."""
    up = calls(lines).select(F.col("callee").alias("src"), F.col("caller").alias("dst")).where("dst <> '<module>'").distinct()
    return reachable(up, lines.sparkSession.sql(f"SELECT '{name}' AS name"), min(depth, 3)).where("depth > 0")


def callgraph(lines: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """(role, name, depth, file, line_no): the definitions of `name`, its callers, and its direct callees:
    each name before a bracket in a definition's lines, with the first of these lines. As the definition's
    own line is one of them, `name` is among its callees."""
    d = functions(lines).where(F.col("name") == name)
    none = F.lit(None)
    own = d.select(F.lit("definition").alias("role"), "name", F.lit(0).alias("depth"), "file", F.col("line_no").cast("long").alias("line_no"))
    up = callers(lines, name, depth).select(F.lit("caller").alias("role"), "name", "depth", none.cast("string").alias("file"), none.cast("long").alias("line_no"))
    body = d.select("file", F.col("line_no").alias("lo"), F.col("end_line").alias("hi")).join(lines, "file").where("line_no BETWEEN lo AND hi")
    found = body.select("file", "lo", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_]{2,})\("), F.lit(1))).alias("name")).where(~F.col("name").isin(*NOISE))
    down = found.groupBy("file", "lo", "name").agg(F.min("line_no").cast("long").alias("line_no")).select(F.lit("callee").alias("role"), "name", F.lit(1).alias("depth"), "file", "line_no")
    return own.unionByName(up).unionByName(down)


def live_functions(lines: DataFrame, entry: tuple[str, ...] = ("main", "run")) -> DataFrame:
    """(file, name, line_no, live, in_degree): live if an entry point reaches it."""
    marks, _ = kept(marked(lines))
    f = marks.where("own IS NOT NULL").select("file", F.col("own").alias("name"), "line_no")
    edges = _called(marks).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    seen = reachable(edges, f.where(F.col("name").isin(*entry)).select("name")).select("name", F.lit(True).alias("live"))
    deg = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("in_degree"))
    return f.join(seen, "name", "left").join(deg, "name", "left").select("file", "name", "line_no", F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def centrality(lines: DataFrame) -> DataFrame:
    """(file, in_degree, out_degree, tag): functions of other files that call a file's public ones."""
    marks, _ = kept(marked(lines))
    c = _called(marks)
    hit = marks.where("own IS NOT NULL AND is_pub").select(F.col("file").alias("dst"), F.col("own").alias("callee")).join(c.select(F.col("file").alias("src"), "caller", "callee").distinct(), "callee").where("src <> dst AND caller <> '<module>'")
    both = hit.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("i")).join(hit.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("o")), "file", "full")
    rows = lines.select("file").distinct().join(both, "file", "left").select("file", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))
    total = F.col("in_degree") + F.col("out_degree")
    return rows.withColumn("tag", F.when(total >= 10, "HUB").when(F.col("in_degree") >= 5, "CORE").when(total == 0, "EDGE").otherwise(""))


def type_hubs(lines: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """(name, files): capitalised names in `least` files or more, the most spread first."""
    names = lines.select("file", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]{2,}+)"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "name").limit(most)


def usage(line: Column, pattern: str) -> Column:
    """How a line uses `pattern`, by what follows it and what stands around it."""
    at = F.instr(line, pattern)
    after = F.ltrim(F.substring(line, at + len(pattern), F.length(line)))
    before = F.substring(line, F.lit(1), at - 1)
    starts = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: after.startswith(x))
    holds = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: line.contains(x))
    return (
        F.when(starts(".clone()", ".to_string()", ".to_owned()"), "clone").when(starts(".contains(", ".starts_with(", ".ends_with("), "method_call").when(starts(".entry(", ".insert(", ".get("), "map_key")
        .when(after.startswith("."), "method_call").when(holds("==", "!="), "comparison").when(holds("format!", "println!", "writeln!", "write!", '"{'), "format_arg")
        .when(before.contains(".entry(") | before.contains(".insert(") | F.rtrim(before).endswith("["), "map_key").otherwise("field_access")
    )


def usages(lines: DataFrame, pattern: str) -> DataFrame:
    """(file, line_no, category) of lines that hold `pattern` and are no comments."""
    return lines.where(F.col("line").contains(pattern) & ~F.trim("line").startswith("//")).select("file", "line_no", usage(F.col("line"), pattern).alias("category"))


def near_files(lines: DataFrame) -> DataFrame:
    """(file, loc, n_pub): thin files, with one public function at most and more than 5 lines, blank ones too."""
    loc = lines.groupBy("file").agg(F.count("*").alias("loc"))
    pub = functions(lines).where("is_pub").groupBy("file").agg(F.count("*").alias("n_pub"))
    return loc.join(pub, "file", "left").withColumn("n_pub", F.coalesce("n_pub", F.lit(0))).where("n_pub <= 1 AND loc > 5")


def frames(trace: DataFrame) -> DataFrame:
    """trace (line): (func, file, line_no) of numbered, `in …` and `panicked at` frames; with no, a line's
    number, if trace has it."""
    no = [c for c in trace.columns if c == "no"]
    t = trace.select(*no, F.trim("line").alias("t"))
    numbered, inside, panicked = F.col("t").rlike(r"^[0-9: ]+\S"), F.col("t").startswith("in "), F.col("t").contains("panicked at")
    rest = F.regexp_replace("t", r"^[0-9: ]+", "")
    name = F.regexp_extract(F.regexp_extract(rest, r"^(.*?)(?: at .*)?$", 1), r"([^:]*)$", 1)
    place = F.when(numbered, F.regexp_extract(rest, r" at (.*)$", 1)).when(inside, F.regexp_extract("t", r"\((.*)\)$", 1)).otherwise(F.regexp_extract("t", r"^.*, (.*)$", 1))
    func = F.when(numbered, name).when(inside, F.trim(F.regexp_extract("t", r"^in ([^(]*)", 1))).when(panicked, F.lit("panic"))
    rows = t.select(*no, func.alias("func"), F.nullif(F.regexp_extract(place, r"^(.*?)(?::\d+)?$", 1), F.lit("")).alias("file"), F.regexp_extract(place, r":(\d+)$", 1).try_cast("long").alias("line_no"), numbered.alias("numbered"))
    return rows.where((F.length("func") >= 2) & ~(F.col("numbered") & F.col("func").isin(*RUNTIME))).drop("numbered")


def risks(lines: DataFrame) -> DataFrame:
    """(file, line_no, risk): unwrapping, expecting, indexing, narrowing casts and unsafe code."""
    t = F.trim("line")
    index = t.contains("[") & t.contains("]") & ~t.contains("//") & t.rlike(r"as usize\]|idx\]|index\]|i\]|pos\]")
    first = F.when(t.contains(".unwrap()"), "unwrap").when(t.contains(".expect("), "expect").when(index, "index")
    found = F.array(first, F.when(t.rlike(r"as u(8|16|32)"), "cast"), F.when(t.contains("unsafe"), "unsafe"))
    return lines.where(~t.startswith("//")).select("file", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("risk"))


def crash(lines: DataFrame, text: str) -> DataFrame:
    """(no, func, def_file, def_line, line_no, risk): the frames of a stack trace, where each function is
    defined, and the risks of the 50 lines from there on. Frames without either have nulls there.

    A definition is the first line that holds `fn ` and the name, in the first file
    that holds `fn name`. A trace has few frames, so they are broadcast.
    """
    trace = lines.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), "\n")).alias("no", "line"))
    found = frames(trace).select("no", "func")
    funcs = F.broadcast(found.select("func").distinct())
    heads = lines.where(F.col("line").contains("fn ")).join(funcs, F.col("line").contains(F.col("func"))).select("func", "file", "line_no", F.col("line").contains(F.concat(F.lit("fn "), "func")).alias("sure"))
    at = heads.groupBy("func", "file").agg(F.min("line_no").alias("line_no"), F.max("sure").alias("sure")).where("sure")
    at = at.groupBy("func").agg(F.min(F.struct("file", "line_no")).alias("d")).select("func", F.col("d.file").alias("def_file"), F.col("d.line_no").alias("def_line"))
    risky = risks(lines)
    near = F.broadcast(at).join(risky, (F.col("def_file") == F.col("file")) & F.expr("line_no BETWEEN def_line AND def_line + 49")).select("func", "line_no", "risk")
    return found.join(at, "func", "left").join(near, "func", "left").select("no", "func", "def_file", "def_line", "line_no", "risk")


def costs(lines: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(name, depth, kind, n): costly calls in functions that `root` reaches within `depth` steps."""
    marks, _ = kept(marked(lines, costly=True))
    edges = _called(marks).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    seen = reachable(edges, lines.sparkSession.sql(f"SELECT '{root}' AS name"), depth)
    rows = marks.where("name IS NOT NULL").select("name", F.explode("kinds").alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n"))
    return rows.join(seen, "name").select("name", "depth", "kind", "n")


def removed_symbols(old: Column, new: Column, stem: str = "", most: int = 3) -> Column:
    """The first words, sorted, of an old text that the new one lacks: four bytes or more, with a letter, in
    lower case, and not the file's own stem. An old text of less than eight bytes has none."""

    def words(text: Column) -> Column:
        found = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) >= 4) & w.rlike("[A-Za-z]"))
        return F.array_distinct(F.transform(found, F.lower))

    gone = F.filter(F.array_except(words(old), words(new)), lambda w: w != stem)
    return F.when(F.octet_length(old) < 8, F.array().cast("array<string>")).otherwise(F.slice(F.array_sort(gone), 1, most))


#: Words after which a file names a symbol; fixed values.
SYMBOL_WORDS = ("fn ", "struct ", "enum ", "trait ", "func ", "class ", "protocol ", "extension ")


def file_symbols(lines: DataFrame, most: int = 20, first: int = 500) -> DataFrame:
    """(file, symbols): the first names, sorted, that a file's first lines define; comments are skipped."""
    t = F.trim("line")
    plain = lines.where((F.col("line_no") <= first) & ~t.startswith("//") & ~t.startswith("#") & ~t.startswith("/*"))
    names = [F.regexp_extract(t, f"^.*?{w}{'' if w in ('fn ', 'func ') else '[<' + chr(39) + ']*'}([A-Za-z][\\p{{L}}\\p{{N}}_]*)", 1) for w in SYMBOL_WORDS]
    found = plain.select("file", F.explode(F.array(*names)).alias("name")).where(F.octet_length("name") >= 3)
    return found.groupBy("file").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("symbols"))
