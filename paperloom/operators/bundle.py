"""Bundles: files rendered into documents of bounded size.

`entries` decides for each file whether it is inlined; `tree_lines` lists all of them as a
tree; `sections` renders the inlined ones, cuts those that exceed a document's budget of
tokens at line ends, and fills documents greedily; the first one begins with the tree.
Everything stays rows: a document is its rows' texts in order of seq, so no task holds a
document's tree or all of a bundle. Sizes are those of the rendered text, to the character;
tokens are characters / 3.6, rounded up.

Formats: md, xml and json.

Defined cases: null contents count as empty; files of equal order keys go by path; paths
are unique; an empty table gives one document with an empty tree; a budget that leaves no
character for a file's content raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import CHARS_PER_TOKEN, fence, human_size, suffix, token_estimate
from paperloom.operators.binning import greedy_bins
from paperloom.operators.pack import skip_reason, within_budget
from paperloom.session import keep

#: Share of a document's characters that a piece of a cut file takes at first, and what it shrinks by if it doesn't fit.
SAFETY, SHRINK = {"md": 0.97, "xml": 0.92, "json": 0.5}, 0.8
#: Languages of fenced blocks by suffix; other suffixes name their own.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".sh": "bash", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".java": "java", ".rb": "ruby", ".ini": "ini", ".cfg": "ini", ".htm": "html", ".txt": "", ".text": "", ".pdf": "text"}
#: After a line's end, as readers of text files see it.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def entries(files: DataFrame, order: list[str] | None = None, most: int = 1 << 62, budget: int = 1 << 62, dedupe: bool = False) -> DataFrame:
    """(path, order's columns, size, tokens, skipped, same_as) of files (path, content, size, kind, ...).

    Reasons in their order: too large, image or binary; with dedupe, a copy of an earlier file
    that is inlined (same_as); over the budget of bytes, from the first file on that would
    exceed it. Copies take up none of the budget.
    """
    order = list(dict.fromkeys([*(order or []), "path"]))
    light = files.select(*order, "size", token_estimate(F.coalesce("content", F.lit(""))).alias("tokens"), skip_reason(F.col("size"), F.col("kind"), most).alias("skipped"), (F.sha2("content", 256) if dedupe else F.col("path")).alias("_h"))
    place = F.struct(*order)
    first = light.where("skipped IS NULL").groupBy("_h").agg(F.min_by(F.struct(*order, "size", "skipped"), place).alias("f"))
    kept = within_budget(first.select("_h", "f.*"), budget, order)
    led = light.join(kept.select("_h", F.col("path").alias("_leader"), F.col("skipped").alias("_late")), "_h", "left")
    copy = F.col("skipped").isNull() & (F.col("path") != F.col("_leader")) & F.col("_late").isNull()
    return led.select(*order, "size", "tokens", F.when(copy, "copy").otherwise(F.coalesce("skipped", "_late")).alias("skipped"), F.when(copy, F.col("_leader")).alias("same_as"))


def tree_lines(paths: DataFrame, root: str = ".") -> DataFrame:
    """(place, line) of the tree of paths (path, note): folders first, each level by name; the root's line has an empty place.

    A node's branches tell of each folder above whether it is its parent's last; that is met
    by joining each node's ancestors with one aggregated last child a folder.
    """
    parts = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(F.col("_parts"), 1, k), "/")
    split = paths.select("path", "note", parts.alias("_parts"))
    files = split.select("path", "note", "_parts", F.lit(1).alias("is_file"))
    folders = split.where(F.size("_parts") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), upto)).alias("path")).distinct()
    folders = folders.select("path", F.lit("/").alias("note"), parts.alias("_parts"), F.lit(0).alias("is_file"))
    nodes = files.unionByName(folders).withColumn("parent", upto(F.size("_parts") - 1)).withColumn("name", F.element_at("_parts", -1))
    last = nodes.groupBy("parent").agg(F.max(F.struct("is_file", "name")).alias("m"))
    lasts = last.select(F.when(F.col("parent") == "", F.col("m.name")).otherwise(F.concat("parent", F.lit("/"), "m.name")).alias("above"), F.col("m.is_file").alias("above_file"))
    above = nodes.select("path", "note", "is_file", "name", "_parts", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_parts")), upto)).alias("depth", "above"))
    above = above.withColumn("above_file", F.when(F.col("depth") == F.size("_parts") - 1, F.col("is_file")).otherwise(0))
    met = above.join(lasts.withColumn("is_last", F.lit(True)), ["above", "above_file"], "left")
    rows = met.groupBy("path", "is_file").agg(F.first("note").alias("note"), F.first("name").alias("name"), F.first("_parts").alias("_parts"), F.array_sort(F.collect_list(F.struct("depth", F.coalesce("is_last", F.lit(False)).alias("l")))).alias("b"))
    n = F.size("b")
    branches = F.array_join(F.transform(F.slice("b", 1, n - 1), lambda x: F.when(x["l"], "    ").otherwise("│   ")), "")
    own = F.when(F.element_at("b", -1)["l"], "└── ").otherwise("├── ")
    place = F.array_join(F.transform("_parts", lambda x, i: F.concat(F.when((i == F.size("_parts") - 1) & (F.col("is_file") == 1), "1").otherwise("0"), x)), "\0")
    top = paths.sparkSession.range(1).select(F.lit("").alias("place"), F.lit(root.rstrip("/") + "/").alias("line"))
    return top.unionByName(rows.select(place.alias("place"), F.concat(branches, own, "name", "note").alias("line")))


def notes(listed: DataFrame) -> DataFrame:
    """(path, note) of entries, for the tree."""
    why = F.when(F.col("same_as").isNotNull(), F.concat(F.lit("  [same as "), "same_as", F.lit("]"))).when(F.col("skipped").isNotNull(), F.concat(F.lit("  [skipped: "), "skipped", F.lit("] ("), human_size(F.col("size")), F.lit(")")))
    return listed.select("path", F.coalesce(why, F.lit("")).alias("note"))


@dataclass
class Format:
    """How one format writes a document: head (with its part), tree, opening of the files, sections between, foot."""

    name: str
    meta: dict

    def head(self, part: Column) -> Column:
        if self.name == "md":
            lines = [f"generated-by: {self.meta['generated_by']}", f"root: {self.meta['root']}", f"files: {self.meta['files_included']} included, {self.meta['files_skipped']} skipped", f"tokens_est: {self.meta['tokens_est']}"]
            lines += [f"omitted over the budget: {self.meta['omitted_budget']} file(s)"] if self.meta.get("omitted_budget") else []
            lines += [f"deduped: {self.meta['deduped']} identical file(s) not inlined"] if "deduped" in self.meta else []
            return F.concat(F.lit(f"# {self.meta['generated_by']} pack\n\n" + "".join(f"- {x}\n" for x in lines) + "- part: "), part, F.lit("\n"))
        if self.name == "xml":
            kept = {"generated-by": "generated_by", "root": "root", "files": "files_included", "tokens-est": "tokens_est", "omitted-budget": "omitted_budget", "deduped": "deduped"}
            return F.concat(F.lit("<context"), *(F.concat(F.lit(f" {k}="), quoted(F.lit(str(self.meta[m])))) for k, m in kept.items() if self.meta.get(m) is not None), F.lit(' part="'), part, F.lit('">\n'))
        pairs = [F.concat(F.lit(f'    "{k}": '), json_text(F.lit(v)) if isinstance(v, str) else F.lit(str(v)), F.lit(",\n")) for k, v in self.meta.items() if v is not None]
        return F.concat(F.lit('{\n  "meta": {\n'), *pairs, F.lit('    "part": "'), part, F.lit('"\n  },\n'))

    def tree(self, longest_fence: str) -> tuple[str, str, str]:
        """What stands before and after the tree's lines, and in place of a tree."""
        return {"md": (f"\n## Tree\n\n{longest_fence}\n", f"\n{longest_fence}\n", ""), "xml": ("<tree><![CDATA[", "]]></tree>\n", ""), "json": ('  "tree": "', '",\n', '  "tree": "",\n')}[self.name]

    def tree_line(self, line: Column) -> Column:
        return {"md": line, "xml": cdata_body(line), "json": inner_json(line)}[self.name]

    @property
    def between_lines(self) -> str:
        return "\\n" if self.name == "json" else "\n"

    @property
    def opening(self) -> tuple[str, str]:
        """Before the sections, if there are any and if not."""
        return {"md": ("\n## Files\n\n", ""), "xml": ("", ""), "json": ('  "files": [\n', '  "files": []')}[self.name]

    @property
    def foot(self) -> tuple[str, str]:
        return {"md": ("", ""), "xml": ("</context>\n", "</context>\n"), "json": ("\n  ]\n}\n", "\n}\n")}[self.name]

    @property
    def between(self) -> str:
        return {"md": "\n", "xml": "", "json": ",\n"}[self.name]

    def section(self, path: Column, text: Column, continued: Column) -> Column:
        if self.name == "md":
            body = F.regexp_replace(text, r"\n+\z", "")
            language = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix(path)), F.regexp_replace(suffix(path), r"^\.", ""))
            return F.concat(F.lit("### `"), path, F.when(continued, "` (continued)").otherwise("`"), F.lit("\n\n"), fence(body), language, F.lit("\n"), body, F.lit("\n"), fence(body), F.lit("\n"))
        tokens = token_estimate(text).cast("string")
        if self.name == "xml":
            return F.concat(F.lit("<file path="), quoted(path), F.lit(' tokens-est="'), tokens, F.when(continued, '" continued="true">').otherwise('">'), F.lit("<![CDATA["), cdata_body(text), F.lit("]]></file>\n"))
        return F.concat(F.lit('    {\n      "path": '), json_text(path), F.lit(',\n      "tokens_est": '), tokens, F.lit(',\n      "content": '), json_text(text), F.when(continued, ',\n      "continued": true').otherwise(""), F.lit("\n    }"))


def quoted(value: Column) -> Column:
    """An XML attribute's value in quotes."""
    safe = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    double, single = F.contains(safe, F.lit('"')), F.contains(safe, F.lit("'"))
    return F.when(double & ~single, F.concat(F.lit("'"), safe, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def cdata_body(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def json_text(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def inner_json(text: Column) -> Column:
    """A JSON string without its quotes."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(3), F.length(listed) - 4)


def _pieces(large: DataFrame, form: Format, room: int, tokens: int, around: int) -> DataFrame:
    """(path, piece, content): files cut at line ends into pieces whose section is within room characters.

    around is what a document has beside its sections. Each file's lines are filled greedily into what is left beside its own section's frame;
    if a piece still doesn't fit, its file is cut anew with a smaller share.
    """
    frame = F.char_length(form.section(F.col("path"), F.lit(""), F.lit(True)))
    todo = keep(large.select("path", "content", F.floor((tokens - F.ceil((frame + around) / CHARS_PER_TOKEN)) * CHARS_PER_TOKEN * SAFETY[form.name]).cast("bigint").alias("most")))
    done = None
    while not todo.isEmpty():
        if tight := todo.where("most < 1").first():
            raise ValueError(f"the budget is too small to fit any content of {tight['path']}")
        lines = todo.select("path", "most", F.posexplode(F.split("content", LINE_END)).alias("line", "text"))
        # A line above the budget is cut as it is.
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("text") / F.col("most")).cast("int") - 1)), lambda i: F.substring(F.col("text"), (i * F.col("most") + 1).cast("int"), F.col("most").cast("int")))
        lines = keep(lines.select("path", "most", "line", F.posexplode(cut).alias("bit", "text")).where("text <> ''"))
        placed = greedy_bins(lines.withColumn("_n", F.char_length("text")), "most", "_n", ["line", "bit"], ["path"], "piece").select("path", "line", "bit", "piece")
        joined = lines.join(placed, ["path", "line", "bit"]).groupBy("path", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "bit", "text"))), lambda x: x["text"]), "").alias("content"))
        fits = F.char_length(form.section(F.col("path"), F.col("content"), F.lit(True))) <= room
        made = keep(joined.withColumn("_fits", fits))
        bad = made.where(~F.col("_fits")).select("path").distinct()
        good = made.join(bad, "path", "left_anti").select("path", "piece", "content")
        done = good if done is None else done.unionByName(good)
        todo = keep(todo.join(bad, "path", "left_semi").withColumn("most", F.floor(F.col("most") * SHRINK).cast("bigint")))
    return done


def sections(files: DataFrame, listed: DataFrame, tokens: int | None = None, fmt: str = "md", root: str = ".", name: str = "paperloom", order: list[str] | None = None) -> DataFrame:
    """(part, seq array<bigint>, kind, path, text): the bundle's documents as rows.

    listed are files' entries. Documents hold at most so many tokens; a tree that is larger
    fills the first one alone. Kinds: head, tree, open, file and foot.
    """
    order = list(dict.fromkeys([*(order or []), "path"]))
    listed = keep(listed)
    live = F.col("skipped").isNull()
    got = listed.agg(F.count_if(live).alias("i"), F.count_if(~live).alias("s"), F.sum(F.when(live, F.col("size"))).alias("b"), F.sum(F.when(live, F.col("tokens"))).alias("t"), F.count_if(F.col("skipped") == "over-budget").alias("o"), F.count("same_as").alias("d")).first()
    meta = {"generated_by": name, "root": root, "files_included": got["i"], "files_skipped": got["s"], "bytes": got["b"] or 0, "tokens_est": got["t"] or 0, "omitted_budget": got["o"] or None}
    form = Format(fmt, meta | ({"deduped": got["d"]} if got["d"] else {}))
    spark = files.sparkSession
    lines = keep(tree_lines(notes(listed), root))
    said = form.tree_line(F.col("line"))
    shape = lines.agg(F.sum(F.char_length(said) + len(form.between_lines)).alias("n"), F.max(F.char_length(fence(F.col("line")))).alias("f")).first()
    before, after, without = form.tree("`" * (shape["f"] or 3))
    tree_size = len(before) + shape["n"] - len(form.between_lines) + len(after) - len(without)
    inlined, contents = listed.where(live).select(*order), files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    text = form.section(F.col("path"), F.col("content"), F.coalesce(F.col("piece") > 1, F.lit(False)))
    if tokens is None:
        placed, cut = inlined.withColumn("piece", F.lit(0).cast("bigint")).withColumn("part", F.lit(1).cast("bigint")), None
    else:
        head = spark.range(1).select(F.char_length(form.head(F.lit("1/1")))).first()[0]
        # All but the sections; the one between too many is given back.
        around = head + len(without) + len(form.opening[0]) + len(form.foot[0])
        room = int(tokens * CHARS_PER_TOKEN) - around
        # Sizes alone are dealt out; texts meet their places at the end.
        sizes = contents.withColumn("piece", F.lit(0).cast("bigint")).select("path", "piece", F.char_length(text).alias("_n"))
        sized = keep(inlined.join(sizes, "path"))
        large = sized.where(F.col("_n") > room).select("path")
        cut = None if large.isEmpty() else _pieces(contents.join(large, "path", "left_semi"), form, room, tokens, around)
        sized = sized.where(F.col("_n") <= room)
        if cut is not None:
            sized = sized.unionByName(cut.select("path", "piece", F.char_length(text).alias("_n")).join(inlined, "path"))
        sized = sized.select(F.lit(1).alias("_first"), *order, "piece", (F.col("_n") + len(form.between)).alias("_n"))
        tree = spark.range(1).select(F.lit(0).alias("_first"), *(F.lit(None).cast(sized.schema[c].dataType).alias(c) for c in order), F.lit(0).cast("bigint").alias("piece"), F.lit(tree_size).cast("int").alias("_n"))
        placed = greedy_bins(tree.unionByName(sized), room + len(form.between), "_n", ["_first", *order, "piece"], to="part").where("_first = 1").drop("_first", "_n")
    placed = keep(placed)
    most = max(1, placed.agg(F.max("part")).first()[0] or 1)
    # The rank of a section in its document: its own order keys, kept as a struct.
    first = placed.groupBy("part").agg(F.min(F.struct(*order, "piece")).alias("_lead"))
    leads = placed.join(first, "part")
    told = leads.where("piece = 0").join(contents, "path").withColumn("text", text)
    if cut is not None:
        told = told.unionByName(leads.where("piece > 0").join(cut, ["path", "piece"]).withColumn("text", text), allowMissingColumns=True)
    shown = told.select("part", F.lit(3).alias("step"), F.struct(*order, "piece").alias("key"), F.lit("").alias("place"), F.lit("file").alias("kind"), "path", F.concat(F.when(F.struct(*order, "piece") == F.col("_lead"), "").otherwise(form.between), "text").alias("text"))
    some = first.select("part", F.lit(True).alias("_some"))
    frames = spark.range(1, most + 1).select(F.col("id").alias("part")).join(some, "part", "left")
    has = F.col("_some").isNotNull()
    frame = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    part = F.concat(F.col("part").cast("string"), F.lit(f"/{most}"))
    around = [
        frame(0, "head", form.head(part)), frame(1, "tree", F.when(F.col("part") == 1, before).otherwise(without)), frame(2, "open", F.concat(F.when(F.col("part") == 1, after).otherwise(""), F.when(has, form.opening[0]).otherwise(form.opening[1]))),
        frame(4, "foot", F.when(has, form.foot[0]).otherwise(form.foot[1])),
    ]
    key = F.lit(None).cast(placed.select(F.struct(*order, "piece").alias("k")).schema["k"].dataType)
    frames = frames.select("part", F.explode(F.array(*around)).alias("f")).select("part", "f.step", key.alias("key"), F.lit("").alias("place"), "f.kind", F.lit(None).cast("string").alias("path"), "f.text")
    tree_rows = lines.select(F.lit(1).cast("bigint").alias("part"), F.lit(1).alias("step"), key.alias("key"), F.concat(F.lit("\1"), "place").alias("place"), F.lit("tree").alias("kind"), F.lit(None).cast("string").alias("path"), F.concat(F.when(F.col("place") == "", "").otherwise(form.between_lines), said).alias("text"))
    return frames.unionByName(tree_rows).unionByName(shown)


#: The order of a document's rows.
SEQ = ["part", "step", "place", "key"]


def documents(rows: DataFrame) -> DataFrame:
    """(part, document) of sections' rows, each document whole in one row: its size is the budget's, but for the tree."""
    piece = F.struct(*SEQ[1:], "text")
    return rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("document"))
