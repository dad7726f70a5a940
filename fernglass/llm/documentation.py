"""Functions paired with their documentation.

Source text is lexed into rows. Running sums over the token order give each
token its line and nesting depth; the function runs from its declaration line
to the token where the depth falls back to its start (or the declared last
line). Line comments on consecutive lines form islands; the token that opens
the declaration looks one token back (lag), and if a comment of its own line
ends on the line directly above, that comment's island is the documentation.

A description is what is left of the comment without markers, tag names, types
and parameter names. Pairs are dropped when nothing is explained: no words, only the name again, bare tags,
work left to do, generated code, words to a tool, licence terms, or code that
was switched off.

Defined results: null content or ids give no pair; repeated rows count once;
a null name restates nothing; a missing line counts as the first; comments cut
off at the start of the text do not attach; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.llm.lexer import explode_tokens, newlines

TODO = r"(?i)^\W*(todo|fixme|xxx|hack|wip|tbd|to be (written|done|documented|described|filled)|document (me|this)|describe (me|this)|add (docs?|documentation|description))\b"
GENERATED = r"(?i)(^\W*(this (file|block|code|function|method|section|stub) (is|was|has been) )?(auto-?\s?|automatically )?generated\b|\bdo not (edit|modify)\b|@generated\b|changes made by hand)"
TOOL = r"(?i)^\W*(eslint|prettier|tslint|jshint|jslint|stylelint|biome|oxlint|standard-|istanbul|c8 |v8 |nyc |deno-|@ts-|ts-|@flow|@jsx|@vite|webpack|noinspection|#?(end)?region\b|sonar|nosonar|codeql|coverage|@__pure__|#__pure__|globals? |exported |sourcemappingurl|vim:|-\*-|cspell|spell-?checker|lgtm|nosemgrep|snyk)"
LICENCE = r"(?i)(^\W*(\(c\)|©|copyright)\b|\blicen[cs]ed under\b|\bspdx-license|\ball rights reserved\b|@licen[cs]e\b|@copyright\b|\bsubject to the terms\b)"
CODE_LINE = (
    r"^\s*(?:(?:const|let|var|return|import|export|if|for|while|switch|case|else|try|catch|throw|await|async|function|class|type|interface|break|continue|do)\b.*[;{(})=,]\s*$"
    r"|[\w$.\[\]]+\s*(?:[-+*/|&?]?=|\()[^.]*[;{]\s*$|[\w$.?]+\([^)]*\)[;,]?\s*$|[})\]]+[;,)]*\s*$|.*=>\s*\{?\s*$|.*;\s*$|.*\{\s*$)"
)
STOP = "a an the this that these those is are was be it its of for to in on and or with function method class callback helper object value component does do will which returns return".split()


def plain_lines(comment: Column) -> Column:
    """Lines of a comment without its markers."""
    inner = F.regexp_replace(F.regexp_replace(comment, r"(?m)^[ \t]*//+[!/]*", ""), r"/\*+!?|\*+/", "")
    return F.transform(F.split(inner, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*\*+", "")))


def explanation(lines: Column) -> Column:
    """The text of a comment that can explain something: no tag names, types, parameter names or examples."""
    text = F.array_join(lines, "\n")
    text = F.regexp_replace(text, r"(?s)@(example|code)\b.*?(?=\n@|\z)", "")
    text = F.regexp_replace(text, r"@(since|version|memberof|module|author|see|name|type|typedef|template|extends|implements|category|group|alias|kind|access|default|ignore|override|readonly|requires)\b[^\n]*", "")
    text = F.regexp_replace(text, r"@(param|arg|argument|property|prop)\b[ \t]*(\{[^\n}]*\}+)?[ \t]*\[?[\w$.]*(=[^\]\n]*)?\]?[ \t]*-?", " ")
    text = F.regexp_replace(text, r"@(returns?|throws|exception|yields?)\b[ \t]*(\{[^\n}]*\}+)?", " ")
    text = F.regexp_replace(text, r"(?m)^\s*(todo|TODO|FIXME|XXX)\b.*$", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"@[\w-]+", " "), r"\s+", " "))


def name_parts(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}]+"), lambda x: x != "")


def _stem(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"(ies|ied|ying)$", "y"), r"(?<=..)(ing|es|ed|e|s)$", "")


def telling_words(text: Column, name: Column) -> Column:
    """Words of ``text`` beyond filler words and the parts of the name or of identifiers it mentions. CJK characters count as words."""
    named = F.concat_ws(" ", name, F.array_join(F.regexp_extract_all(text, F.lit(r"\b[a-z]+[A-Z][A-Za-z0-9]*\b"), F.lit(0)), " "))
    parts = F.transform(F.coalesce(name_parts(named), F.array()), _stem)
    words = F.regexp_extract_all(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{M}\p{N}_$'’]*\p{L}[\p{L}\p{M}\p{N}_$'’]*"), F.lit(0))
    plain = F.filter(words, lambda w: ~w.rlike(r"[a-z0-9][A-Z]|[_$]"))
    return F.filter(plain, lambda w: ~F.lower(w).isin(*STOP) & ~F.array_contains(parts, _stem(F.lower(w))))


def is_telling(comment: Column, name: Column, least: int = 2) -> Column:
    """Whether a comment explains something about what it documents."""
    lines = plain_lines(comment)
    full = F.filter(lines, lambda x: x != "")
    head = F.array_join(full, "\n")
    dead = head.rlike(TODO) | head.rlike(GENERATED) | head.rlike(TOOL) | head.rlike(LICENCE)
    outside = F.filter(F.split(F.regexp_replace(head, r"(?s)@(example|code)\b.*?(?=\n@|\z)", ""), "\n"), lambda x: x != "")
    code = F.size(F.filter(outside, lambda x: x.rlike(CODE_LINE)))
    return ~dead & ~((F.size(outside) > 0) & (2 * code >= F.size(outside))) & (F.size(telling_words(explanation(full), name)) >= least)


BLANKS = "\n\r\t "


def pair_functions(functions: DataFrame, *, code: bool = True) -> DataFrame:
    """(id, name, code, comment, description) of every function with telling documentation of its own.

    ``functions`` has id, text, name, declaration (0-based line of the
    declaration in text). Tokens stay where their row is when it is already
    partitioned by id; the windows then need no further shuffle. Without
    ``code`` the function is delimited all the same, but not cut out.
    """
    rows = functions.select("id", "name", F.coalesce("declaration", F.lit(0)).alias("decl"), "text")
    # an excerpt can begin inside a template string, which then ends with a backtick at a line start above the declaration
    head = F.expr("substring_index(text, char(10), decl)")
    inside = (F.regexp_count(head, F.lit("`")) % 2 == 1) & head.rlike(r"^[^`]*(?<=^|\n)`")
    prefix = F.substring_index("text", "`", 1)
    rows = rows.select("id", "name", F.when(inside, F.col("decl") - F.regexp_count(prefix, F.lit("\n"))).otherwise(F.col("decl")).alias("decl"), F.when(inside, F.substring("text", F.length(prefix) + 2, F.length("text"))).otherwise(F.col("text")).alias("text"))
    # where the line of the declaration begins
    begin = F.when(F.col("decl") > 0, F.length(F.expr("substring_index(text, char(10), decl)")) + 1).otherwise(0)
    rows = rows.select("*", begin.alias("from"), *([F.col("text").alias("source")] if code else []))
    tokens = explode_tokens(rows, "text")
    if code:
        # the source rides along on the first token only
        tokens = tokens.withColumn("source", F.when(F.col("pos") == 0, F.col("source")))
    w = Window.partitionBy("id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.ascii("tok")
    step = F.when(first.isin(*map(ord, "([{")) & (F.col("size") == 1), 1).when(first.isin(*map(ord, ")]}")), -1).otherwise(0)
    # a bracket can bring a regular expression along; a run that begins with one holds its partner too
    step = F.when(first.isin(*map(ord, "([{")) & F.col("tok").rlike(r"^[(\[{][ \t]*/"), 1).otherwise(step)
    comment = F.col("tok").startswith("//") | F.col("tok").startswith("/*")
    left, right = F.ltrim("tok", F.lit(BLANKS)), F.rtrim("tok", F.lit(BLANKS))
    tokens = tokens.select("*", F.length("tok").alias("size"), newlines(F.col("tok")).alias("nl"), comment.alias("comment"))
    tokens = tokens.select("*", step.alias("step"), F.when(F.col("nl") > 0, newlines(left)).otherwise(0).alias("after"), F.when(F.col("nl") > 0, newlines(right)).otherwise(0).alias("upto"), (left == "").alias("blank"))
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = tokens.select("*", sums("nl").alias("at"), sums("step").alias("depth"), sums("size").alias("start"))
    # lines of the first and the last character that is not blank; the first token stays even if blank, as the source rides on it, but stands on no line
    line, last_line = F.col("at") + F.col("nl") - F.col("after"), F.when(F.col("blank"), -1).otherwise(F.col("at") + F.col("upto"))
    seen = placed.filter(~F.col("blank") | (F.col("pos") == 0)).select("*", line.alias("line"), last_line.alias("last_line"))
    lag = lambda c: F.lag(c).over(w)
    seen = seen.select(
        "*",
        (F.col("comment") & (F.coalesce(lag("last_line"), F.lit(-1)) < F.col("line"))).alias("own"),
        F.coalesce(lag("last_line"), F.lit(-1)).alias("over"),
        ((F.col("line") >= F.col("decl")) & (F.coalesce(lag("line"), F.lit(-1)) < F.col("decl"))).alias("opens"),
    )
    run = F.col("own") & F.col("tok").startswith("//") & lag("own") & lag("tok").startswith("//") & (F.col("over") == F.col("line") - 1)
    # the declaration may begin within a run of text, or with its first token
    reaches = (F.col("last_line") >= F.col("decl")) & (F.col("over") < F.col("decl"))
    seen = seen.select("*", (~F.coalesce(run, F.lit(False))).cast("int").alias("fresh"), (F.col("opens") & lag("own") & (F.col("over") == F.col("decl") - 1)).alias("attached"), reaches.alias("reaches"))
    through = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.select("*", F.sum("fresh").over(through).alias("island"), F.max(F.when(F.col("reaches"), F.col("depth"))).over(through).alias("base"))
    closes = F.col("tok").startswith("}") & (F.col("depth") == F.col("base") + 1) & (F.col("line") >= F.col("decl"))
    doc = F.when(F.col("attached"), F.col("island") - 1)
    aggs = [
        F.max("from").alias("from"),
        F.min(F.when(closes, F.col("start") + 1)).alias("to"),
        F.max(doc).alias("doc"),
        F.collect_list(F.when(F.col("own") & (F.col("last_line") < F.col("decl")), F.struct("island", "pos", "tok"))).alias("comments"),
    ]
    if code:
        aggs.append(F.max("source").alias("source"))
    found = seen.groupBy("id").agg(F.max("name").alias("name"), *aggs).filter("doc is not null")
    # a function ends after it begins, or is cut off
    found = found.filter(F.col("to").isNull() | (F.col("to") > F.col("from")))
    own = F.filter("comments", lambda x: x["island"] == F.col("doc"))
    text = F.array_join(F.transform(F.array_sort(own), lambda x: x["tok"]), "\n")
    found = found.withColumn("comment", text).filter(is_telling(F.col("comment"), F.col("name")))
    out = [F.col("id"), F.col("name"), F.col("comment"), explanation(F.filter(plain_lines(F.col("comment")), lambda x: x != "")).alias("description")]
    if code:
        cut = F.when(F.col("to").isNull(), F.expr("substring(source, `from` + 1)")).otherwise(F.expr("substring(source, `from` + 1, `to` - `from`)"))
        out.insert(2, F.ltrim(cut, F.lit(BLANKS)).alias("code"))
    return found.select(*out)
