"""Source files that do not parse: adjacency, nesting and statement checks over lexed rows.

Files are lexed into rows of token classes in one regex pass. Three checks run
over these rows, each a windowed reduction within the file:

* every pair of neighbouring tokens must be one the grammar of the file's
  language can produce (an anti-join against the derived pair table);
* brackets and JSX tags must nest: at each depth, openings and closings of the
  same kind alternate, and the file ends at depth 0;
* statements must follow their productions. Within a few neighbours of a token
  (lags and leads): what may be assigned to, bound, declared, imported,
  exported or caught, the initialiser of a const, statements that need a
  function or a loop around them. At the depth of a bracket: handlers of try,
  what else may follow, await in a function that is not async, names declared
  twice in a block, and colons, which outside TypeScript need a pending ``?`` or
  a ``case`` when directly inside parentheses or square brackets or after a
  closing parenthesis; a string key needs an object, not a block; items are
  left out only between square brackets.

Runs of blanks are shortened to one, and those after a line end left out, before lexing, so a look
back over blanks is complete however long they were.

Defined results: null content is not judged; empty files, comments alone, a
leading byte-order mark and a ``#!`` line are valid; extensions without a
grammar are never reported; repeated file ids are judged together as one
file, so give each file once. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.llm.grammar import ASSIGN, CONTEXTUAL, KEYWORDS, TYPED, permissible
from fernglass.llm.lexer import DOUBLE, REGEX, SINGLE

def _either(words: list[str]) -> str:
    """Alternation of words, grouped by first letter so that most words are dismissed at once."""
    heads = sorted({w[0] for w in words})
    return "|".join(f"{h}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == h), reverse=True))})" for h in heads)


_WORD = _either(KEYWORDS)
_CHAIN = rf"(?!(?:{_WORD})\b)[\p{{L}}_$#][\w$\p{{L}}]*+(?:\??\.[\p{{L}}_$#][\w$\p{{L}}]*+)*+"
_STRING = rf"{SINGLE[:-1]}|{DOUBLE[:-1]}"
_NUMBER = r"(?:0[xX][\da-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?+|\.\d[\d_]*+)(?:[eE][+-]?\d++)?+)n?+(?![\w$])"
_PLAIN = rf"(?:{_CHAIN}(?:\(\))?+|{_STRING}|{_NUMBER})"
#: A call with plain arguments on one line is one operand; it ends with its closing parenthesis.
_NAME = rf"{_CHAIN}(?:\((?:{_PLAIN}(?:, {_PLAIN})*+)?+\))?+"
_ATOM = rf"(?:{_NAME}|{_STRING}|{_NUMBER})"
#: Operators that join operands into one token; commas too, as lists of operands behave like one operand.
_JOIN = rf"[ ]?(?:,|===|!==|&&|\|\||[+*])[ ](?!(?:{_either([*CONTEXTUAL, *TYPED])})\b)"
_TEMPLATE = r"`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{)|\$\{[^{}`]*+(?:(?:`[^`]*+`|\{[^{}]*+\})[^{}`]*+)*+\})[^`\\$]*+)*+`"
#: Blanks have been shortened to one before.
_BEFORE_REGEX = r"(?<=^|[=(,:;!&|?{\[+*%~^>\n]|[=(,:;!&|?{\[+*%~^>][ \t]|\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do|await|yield)|\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do|await|yield)[ \t])"
#: In types, angle brackets that stand together close or open lists of types, so only scripts shift with them unseparated.
_SHIFT = r">>>(?!=)|>>(?![>=])|<<(?!=)"
_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=@]"
_CONFLICT = r"<{7}(?=[ \r\n])|>{7}(?=[ \r\n])|={7}(?=[ \r\n])|\|{7}(?=[ \r\n])"
_SPACE = r"(?:[ \t\r\f\x0B\x{A0}\x{FEFF}\x{2028}\x{2029}]++|//[^\n]*+|/\*[\s\S]*?\*/)*+"
_START = rf"{_CONFLICT}|{_ATOM}(?:{_JOIN}{_ATOM})*+|(?:{_WORD})\b|\??\.[\p{{L}}_$#][\w$\p{{L}}]*+(?:\??\.[\p{{L}}_$#][\w$\p{{L}}]*+)*+|{_TEMPLATE}|(?=/){_BEFORE_REGEX}{REGEX}"
_END = rf"{_PUNCT}|\x04\z|[^\n]"
_BRACES = r"\{[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+\}"
_TAG = rf"<[A-Za-z][\w.:-]*+(?=[\s/>])(?!\s+extends\b)(?:\s++[\w:-]++(?:=(?:\"[^\"]*+\"|'[^']*+'|{_BRACES}))?+|\s*+\{{\.\.\.[^{{}}]*+\}})*+\s*+"
#: The text of an element is part of the tag before it, or of the closing tag when it follows an expression in braces.
_AFTER = r"(?:[^<>{}();=:]*+(?=</|<[A-Za-z])|[^<>{}();=:\n]*+(?=\{))?+"
_CLOSE = rf"</(?:[A-Za-z][\w.:-]*+)?+\s*+>{_AFTER}"
_JSX = rf"{_CLOSE}|(?=(?:[^<>{{}}\n]++|[^<>{{}}();=]++)</)(?<=\}}[ \t]?\r?\n?)[^<>{{}}]++{_CLOSE}|(?<![\w$)\]])(?:<>|{_TAG}>)(?:[^<>{{}}]*+(?=[<{{]))?+|(?<![\w$)\]]){_TAG}/>"

_IDENT = r"[\p{L}_$][\w$\p{L}]*"
#: What a token merged of operands holds: a comma, more than names and commas, an optional chain at its end, an operator
#: before its last operand, a call at its end, and one that ends in a call of one name with names alone, which may head a function.
LISTED, COMPOUND, OPTIONAL, BINARY, CALL, HEAD = 1, 2, 4, 8, 16, 32
#: Whether it is, or begins with, a name or a literal.
NAME, LITERAL = 64, 128

BAD = "BAD"
PUNCTUATION = (
    "( ) [ ] { } ; , < > << >> >>> <= >= == != === !== + - * / % ** ++ -- ! ~ & | ^ && || ?? ?. ? : = => ... @ += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="
).split()
EXTENSIONS = {"ts": "ts", "mts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "jsx": "jsx"}


def language(path: Column) -> Column:
    """Grammar of a file by the extension of its path; null if there is none."""
    extension = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(extension == e, name).otherwise(out)
    return F.when(path.contains("."), out)


#: A line end before a token, with the block comments between, is part of it; other line ends and comments are passed over.
_BEFORE = r"(?:[ \x{A0}\x{FEFF}\x{2028}\x{2029}]|/\*[\s\S]*?\*/)*+"
_LINE_END = rf"(?:\n{_BEFORE})?+"


def _pattern(lang: str) -> str:
    """Tokens of one language, each in the first group."""
    # a line end matters only after what can end a statement: after an opening or a separator it is passed over
    after = rf"{_SPACE}(?:(?<=[;{{(\[,])(?:\n{_SPACE})++)?+"
    markup = f"{_JSX}|" if lang in ("tsx", "jsx") else ""
    core = rf"{markup}{_START}|{_SHIFT if lang in ('js', 'jsx') else '(?<= )(?:>>>?|<<)(?= )'}|{_END}"
    return rf"(?:\n{_SPACE}(?=\n))*+({_LINE_END}(?:{core})){after}"


def lex_files(files: DataFrame) -> DataFrame:
    """(file_id, lang, pos, tok): significant tokens of every file with a grammar, those after a line end with it before them."""
    head = F.col("content").startswith("\ufeff") | F.col("content").startswith("#!")
    text = F.when(head, F.regexp_replace(F.col("content"), r"^\x{FEFF}?(?:#![^\n]*)?", "")).otherwise(F.col("content"))
    # blanks after a line end or a blank are left out
    text = F.regexp_replace(text, r"(?<=\n)[ \t\r\n]++|(?<=[ \t])[ \t\r\f\x0B]++", "")
    text = F.concat(F.lit("\n"), text, F.lit("\n\x04"))
    rows = files.filter("content is not null").select("file_id", language(F.col("path")).alias("lang"), text.alias("text")).filter("lang is not null")
    tokens = F.lit(None)
    for lang in ("js", "jsx", "ts", "tsx"):
        tokens = F.when(F.col("lang") == lang, F.regexp_extract_all("text", F.lit(_pattern(lang)), F.lit(1))).otherwise(tokens)
    return rows.select("file_id", "lang", F.posexplode(tokens).alias("pos", "tok"))


def with_classes(tokens: DataFrame) -> DataFrame:
    """Adds ``cls`` and ``end``, the class of a token as its left and its right neighbour see it, and ``nl``, whether a line end is before it.

    Runs on every token, so it compares character codes that are taken once,
    not patterns.
    """
    tok, lang = F.col("tok"), F.col("lang")
    short = F.col("n") <= max(map(len, [*KEYWORDS, *CONTEXTUAL, *TYPED]))
    known = short & (tok.isin(*KEYWORDS, *CONTEXTUAL) | (lang.isin("ts", "tsx") & tok.isin(*TYPED)))
    nl = F.ascii(tok) == 10
    second = F.ascii(F.substring(tok, 2, 1))
    bare = F.when(nl, F.when((second == 32) | (second == 47) | (second > 127), F.regexp_replace(tok, rf"^\n{_BEFORE}", "")).otherwise(F.expr("substring(tok, 2)"))).otherwise(tok)
    # never null, which spares the compiled loop its null checks: the JVM leaves a loop over 8,000 bytes uncompiled
    tokens = tokens.select("file_id", "lang", "pos", F.coalesce(bare, F.lit("")).alias("tok"), F.coalesce(nl, F.lit(False)).alias("nl"))
    size = F.octet_length(tok)
    rows = tokens.select("*", F.ascii(tok).alias("c1"), F.when(size > 1, F.ascii(F.substring(tok, -1, 1))).otherwise(F.ascii(tok)).alias("c2"), size.alias("n"))
    code = {k: ord(k) for k in "<.?`/'\")\n\x04 "}

    def letter(c: str) -> Column:
        x = F.col(c)
        other = F.substring(tok, 1, 1) if c == "c1" else F.substring(tok, -1, 1)
        return x.between(97, 122) | x.between(65, 90) | x.isin(95, 36, 35) | ((x > 126) & other.rlike(r"\p{L}"))

    def digit(c: str) -> Column:
        return F.col(c).between(48, 57)

    long = F.col("n") > 1
    element = F.when(tok.contains("</"), "JCLOSE").when(tok.endswith("/>"), "JSELF").otherwise("JTAG")
    in_jsx = lang.isin("tsx", "jsx") & long & (((F.col("c1") == code["<"]) & ~tok.isin("<=", "<<=", "<<")) | (tok.contains("</") & ~F.col("c1").isin(code["'"], code['"'], code["`"], code["/"]) & tok.rlike(r"</[\w.:-]*\s*>[^'\"`]*$")))
    cls = (
        F.when(in_jsx, element)
        .when(letter("c1"), F.when(known, tok).otherwise("ID"))
        .when(digit("c1"), "NUM")
        .when(tok.isin(*PUNCTUATION), tok)
        .when(long & (F.col("c1") == code["."]), F.when(F.ascii(F.substring(tok, 2, 1)).between(48, 57), "NUM").otherwise("MEM"))
        .when(long & (F.col("c1") == code["?"]), "MEM")
        .when(long & F.col("c1").isin(code["'"], code['"']), "STR")
        .when(long & (F.col("c1") == code["`"]), "TPL")
        .when(long & (F.col("c1") == code["/"]), "RX")
        .when(F.col("c1") == code["\x04"], "END")
        .otherwise(BAD)
    )
    rows = rows.select("*", cls.alias("cls"))
    end = (
        F.when(~long | ~F.col("cls").isin("ID", "NUM", "STR", "MEM"), F.col("cls"))
        .when(letter("c2"), "ID")
        .when(digit("c2"), F.when((F.col("cls") == "NUM") & ~tok.contains(" "), "NUM").otherwise("ID"))
        .when(F.col("c2") == code[")"], ")")
        .when(F.col("c2").isin(code["'"], code['"']), "STR")
        .otherwise(F.col("cls"))
    )
    # what a merged token holds, as flags; and the hash of a single name
    flag = lambda on, bit: F.when(on, bit).otherwise(0)
    operand = F.col("cls").isin("ID", "NUM", "STR") & long
    call = F.col("c2") == code[")"]
    kind = F.when(F.col("cls") == "ID", NAME).when(F.col("cls").isin("NUM", "STR", "TPL", "RX"), LITERAL).otherwise(0)
    shape = kind + F.when(
        operand,
        flag(tok.contains(","), LISTED)
        # without a blank, only a member, a call or a literal is more than a name
        + flag(tok.contains(".") | tok.contains("(") | (F.col("cls") == "STR") | (tok.contains(" ") & tok.rlike(r"[?+*&|='\"]")), COMPOUND)
        + flag(tok.contains("?.") & tok.rlike(r"\?\.[\w$.]*$"), OPTIONAL)
        + flag(tok.contains(" ") & tok.rlike(r"[+*&|=] [^,(]*$"), BINARY)
        + flag(call, CALL)
        + flag(call & tok.rlike(rf"(?:^|, )#?{_IDENT}\((?:{_IDENT}(?:, {_IDENT})*)?\)$"), HEAD),
    ).otherwise(0)
    name = F.when((F.col("cls") == "ID") & ~tok.contains(" "), F.xxhash64(tok))
    return rows.select("file_id", "lang", "pos", "nl", "cls", end.alias("end"), shape.alias("shape"), name.alias("name"))


def placed_tokens(files: DataFrame) -> DataFrame:
    """Token rows with their classes, those of their neighbours, whether a line end lies before, and the depth before."""
    rows = with_classes(lex_files(files))
    step = F.when(F.col("cls").isin("(", "[", "{", "JTAG"), 1).when(F.col("cls").isin(")", "]", "}", "JCLOSE"), -1).otherwise(0)
    w = Window.partitionBy("file_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lag = lambda c, n, none: F.coalesce(F.lag(c, n).over(w), F.lit(none))
    return rows.select(
        "*",
        F.coalesce(F.sum(step).over(before), F.lit(0)).alias("depth"),
        step.alias("step"),
        lag("end", 1, "START").alias("prev"),
        lag("end", 2, "START").alias("prev2"),
        lag("end", 3, "START").alias("prev3"),
        lag("shape", 1, 0).alias("left_shape"),
        F.lead("cls").over(w).alias("next"),
        F.lead("nl").over(w).alias("next_nl"),
    )


def misstated() -> Column:
    """Whether a token breaks the production of its statement, as far as its neighbours tell."""
    c = F.col
    cls, prev, prev2, prev3, follows = c("cls"), c("prev"), c("prev2"), c("prev3"), c("next")
    has = lambda col, bit: F.col(col).bitwiseAND(F.lit(bit)) != 0
    name, script, markup = cls == "ID", c("lang").isin("js", "jsx"), c("lang").isin("tsx", "jsx")
    listed, compound, call, head = (has("shape", x) for x in (LISTED, COMPOUND, CALL, HEAD))
    begins = prev2.isin("START", ";", "}")
    target = cls.isin(*ASSIGN) & (
        has("left_shape", OPTIONAL)
        | has("left_shape", BINARY)
        | (has("left_shape", NAME) & has("left_shape", CALL) & (prev == ")"))
        | (has("left_shape", LITERAL) & ~has("left_shape", LISTED) & begins & (c("depth") == 0))
    )
    bound = name & prev.isin("const", "let", "var") & compound
    bare = name & (prev == "const") & ~prev2.isin("declare", "as", "<", ",") & (listed | ~F.coalesce(follows, F.lit("END")).isin("=", ":", "of", "in", "!"))
    # the last of several constants, as in ``const a = 1, b;``
    last = (prev == "=") & (prev3 == "const") & listed & (c("end") == "ID") & follows.isin(";", "END")
    function = name & ((prev == "function") | ((prev == "*") & (prev2 == "function"))) & ((call & ~head) | (~call & (listed | compound)))
    first = (prev == "(") & ((prev2 == "function") | (prev3 == "function"))
    parameter = name & first & compound
    body = name & call & ~head & (follows == "{") & ~c("next_nl") & ~prev.isin("extends", "implements") & ~(markup & prev.isin("}", "JTAG", "JCLOSE", "JSELF"))
    imported = name & listed & (follows == "from") & ((prev == "import") | ((prev == "type") & (prev2 == "import")))
    titled = name & prev.isin("class", "interface", "enum") & (listed | compound)
    value = prev2.isin("(", "[", "return", "&&", "||", "??", "?", ",") | ((prev2 == "=") & ~markup)
    literal = (script | prev2.isin("(", "return")) & cls.isin("NUM", "STR")
    shorthand = (prev == "{") & value & follows.isin("}", ",") & ((name & compound) | literal)
    caught = name & (prev == "(") & (prev2 == "catch") & (listed | compound)
    exported = name & (prev == "{") & (prev2 == "export") & compound
    top = (c("depth") == 0) & ((cls == "return") & prev.isin("START", ";", "}") | cls.isin("break", "continue") & prev.isin("START", ";", "}"))
    rules = [target, bound, bare, last, function, parameter, body, imported, titled, shorthand, caught, exported, top & ~follows.isin(":", "(", "=", ",")]
    # few tokens come into question, and only these pay for the rules
    merged = (c("shape").bitwiseAND(F.lit(NAME - 1)) != 0) & (call | prev.isin("const", "let", "var", "function", "*", "(", "{", "=", "import", "type", "class", "interface", "enum"))
    assigned = cls.isin("=", *(x for x in ASSIGN if x != "=")) & (c("left_shape") > NAME)
    asked = merged | (prev == "const") | ((prev == "{") & cls.isin("NUM", "STR")) | assigned | ((c("depth") == 0) & cls.isin("return", "break", "continue"))
    # within a lambda, so that the rules stay out of the compiled loop over all tokens, which the JVM would be too large to compile with them
    broken = F.exists(F.array(F.lit(0)), lambda _: F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False)))
    return F.when(asked, broken).otherwise(False)


def reserved_key() -> Column:
    """A reserved word that names a property, or the colon after it: any may, though no other production puts it there."""
    between = ("{", ",", ";")
    word = F.col("cls").isin(*KEYWORDS) & (F.col("next") == ":") & F.col("prev").isin(*between)
    colon = (F.col("cls") == ":") & F.col("prev").isin(*KEYWORDS) & F.col("prev2").isin(*between)
    return F.coalesce(word | colon, F.lit(False))


def pair_table(spark) -> DataFrame:
    """(lang, prev, cls, nl) of every permissible pair; its size is set by the grammars alone."""
    rows = [(lang, a, b, nl) for lang in ("js", "jsx", "ts", "tsx") for a, b, nl in permissible(lang)]
    return spark.createDataFrame(rows, "lang string, prev string, cls string, nl boolean")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, adjacency, nesting, statement) of files (file_id, path, content) that break a rule, with counts."""
    tokens = placed_tokens(files)
    known = pair_table(files.sparkSession).withColumn("known", F.lit(True))
    # the pair table is a constant of the grammars
    judged = tokens.join(F.broadcast(known), ["lang", "prev", "cls", "nl"], "left").withColumn("odd", F.when(F.col("known").isNull(), ~reserved_key()).otherwise(False)).withColumn("misstated", misstated())
    script = F.col("lang").isin("js", "jsx")
    colon = (F.col("cls") == ":") & (script | (F.col("prev") == "STR"))
    opens, closes = F.col("step") == 1, F.col("step") == -1
    declares = F.col("name").isNotNull() & F.col("prev").isin("const", "let", "class")
    nested_if = (F.col("cls") == "if") & (F.col("prev") == ")")
    hole = (F.col("cls") == ",") & (F.col("prev") == ",")
    wanted = F.col("odd") | F.col("misstated") | hole | opens | closes | declares | nested_if | F.col("cls").isin("END", "await") | colon | (script & F.col("cls").isin("?", "case", ",", ";"))
    level = F.when(opens, F.col("depth")).otherwise(F.col("depth") - 1)
    # the body of a plain function or method: its head stands right before, on the same line
    plain = (F.col("cls") == "{") & (F.col("left_shape").bitwiseAND(F.lit(NAME)) != 0) & (F.col("prev") == ")") & ~F.col("nl") & (((F.col("prev2") == "function") & (F.col("prev3") != "async")) | F.col("prev2").isin("{", ";", "static", "public", "private", "protected"))
    marks = judged.filter(wanted).select("file_id", "lang", "pos", "prev", "cls", "next", "odd", "misstated", "depth", "step", level.alias("level"), plain.alias("plain"), nested_if.alias("nested_if"), F.when(declares, F.col("name")).alias("name"))
    w = Window.partitionBy("file_id", "level").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    bracket = F.when(F.col("step") != 0, F.col("cls"))
    at = lambda on: F.coalesce(F.max(F.when(on, F.col("pos"))).over(upto), F.lit(-1))
    marks = marks.select(
        "*",
        F.last(bracket, ignorenulls=True).over(upto).alias("partner"),
        F.last(F.when(F.col("step") == 1, F.struct("prev", "plain")), ignorenulls=True).over(upto).alias("opener"),
        F.last(F.when((F.col("step") == 1) & (F.col("cls") == "("), F.col("prev")), ignorenulls=True).over(upto).alias("condition"),
        # the place of the bracket that opened this block tells it from others of its level
        at(F.col("step") == 1).alias("block"),
        # a ? or case since the last bracket or separator
        (at(F.col("cls").isin("?", "case")) > at((F.col("step") != 0) | F.col("cls").isin(",", ";"))).alias("pending"),
    )
    named = F.when(F.col("name").isNotNull(), F.xxhash64("level", "block", "name")).alias("named")
    marks = marks.select("*", F.col("opener.prev").alias("context"), F.col("opener.plain").alias("in_plain"), named)
    matches = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{", "JCLOSE", "JTAG")])
    nesting = ((F.col("step") == -1) & ~F.col("partner").eqNullSafe(matches[F.col("cls")])) | ((F.col("cls") == "END") & (F.col("depth") != 0)) | ((F.col("step") == 1) & F.col("partner").isin("(", "[", "{", "JTAG"))
    stray = script & (F.col("cls") == ":") & ~F.col("pending") & (F.col("partner").isin("(", "[") | (F.col("prev") == ")"))
    block = (F.col("cls") == ":") & (F.col("prev") == "STR") & (F.col("partner") == "{") & F.col("context").isin("START", ";") & ~F.col("pending")
    ends = (F.col("cls") == "}") & (F.col("partner") == "{")
    handler = ends & ((F.col("context") == "try") & ~F.col("next").isin("catch", "finally") | (F.col("context") == "finally") & (F.col("next") == "catch"))
    other = ends & (F.col("next") == "else") & (F.col("context").isin("try", "finally", "do") | ((F.col("context") == ")") & F.col("condition").isin("while", "for", "switch", "catch", "with")))
    # two in a row are right only where an if without braces holds another
    twice = ends & (F.col("next") == "else") & (F.col("context") == "else")
    awaits = (F.col("cls") == "await") & (F.col("partner") == "{") & F.col("in_plain") & ~F.col("next").isin(":", "(", "=", ",", "}")
    counted = marks.groupBy("file_id", "named").agg(
        F.count_if("odd").alias("adjacency"),
        F.count_if(nesting).alias("nesting"),
        F.count_if(F.col("misstated") | stray | block | handler | other | awaits | (hole & (F.col("partner") != "["))).alias("statement"),
        F.count_if("nested_if").alias("nested_ifs"),
        F.count_if(twice).alias("elses"),
        F.greatest(F.count("named") - 1, F.lit(0)).alias("again"),
    )
    bad = counted.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("adjacency", "nesting", "statement", "nested_ifs", "elses", "again")])
    statement = F.col("statement") + F.col("again") + F.when(F.col("nested_ifs") == 0, F.col("elses")).otherwise(0)
    return bad.select("file_id", "adjacency", "nesting", statement.alias("statement")).filter("adjacency + nesting + statement > 0")
