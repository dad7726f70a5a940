"""Which tokens may stand next to each other, derived from grammars of JavaScript, TypeScript and JSX.

The grammars are loose on precedence and nesting, as only adjacency is taken
from them: two tokens may be neighbours if some production puts a symbol that
can end with the first next to a symbol that can begin with the second. A line
end may also stand for a semicolon, between a token that can end a statement
and one that can begin one.

Words in ``$`` are nonterminals; ID, NUM, STR, TPL, RX are literals, MEM is a
member access (``.name``), J* are JSX pieces, START and END the file's ends.
"""

from __future__ import annotations

from functools import lru_cache

BINARY = "+ - * / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> instanceof in".split()
ASSIGN = "= += -= *= /= %= **= &&= ||= ??= &= |= ^= <<= >>= >>>=".split()
KEYWORDS = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with"
).split()
CONTEXTUAL = "async await yield let of as from get set static".split()
TYPED = "type interface implements private public protected readonly abstract declare namespace module keyof is infer satisfies asserts override unique accessor".split()

SCRIPT = {
    "$file": "START END | START $stmts END",
    "$stmts": "$stmt | $stmts $stmt",
    "$stmt": "$open ; | $open | $block | ; | if ( $list ) $stmt | if ( $list ) $stmt else $stmt | for ( $for ) $stmt | for await ( $for ) $stmt | while ( $list ) $stmt | do $stmt while ( $list )"
    " | switch ( $list ) { $cases } | switch ( $list ) { } | try $block $handlers | ID : $stmt | $function | $class | export $class | export $function | export default $function | export default $class | with ( $list ) $stmt",
    "$open": "$list | $vars | return | return $list | throw $list | break | break ID | continue | continue ID | debugger | import $import | export $export",
    "$block": "{ } | { $stmts }",
    "$handlers": "catch ( $pattern ) $block | catch $block | finally $block | $handlers finally $block",
    "$cases": "$case | $cases $case",
    "$case": "case $list : | case $list : $stmts | default : | default : $stmts",
    "$vars": "const $binds | let $binds | var $binds",
    "$binds": "$bind | $binds , $bind",
    "$bind": "$pattern | $pattern = $expr",
    "$pattern": "$name | { $props } | { } | [ $items ] | [ ]",
    "$name": "ID | async | await | yield | let | of | as | from | get | set | static",
    "$for": "; ; | $head ; $list ; $list | $head ; ; $list | $head ; $list ; | ; $list ; | ; $list ; $list | ; ; $list | const $pattern of $expr | let $pattern of $expr | var $pattern of $expr | const $pattern in $expr"
    " | let $pattern in $expr | var $pattern in $expr | $expr of $expr | $expr in $expr",
    "$head": "$list | $vars",
    "$import": "STR | $name from STR | { } from STR | { $specs } from STR | * as $name from STR | $name , { $specs } from STR | $name , * as $name from STR | STR with { $props }",
    "$specs": "$spec | $specs , $spec | $specs ,",
    "$spec": "$name | $name as $name | default as $name | STR as $name | $name as default",
    "$export": "$vars | { } | { $specs } | { $specs } from STR | * from STR | * as $name from STR | default $expr",
    "$list": "$expr | $list , $expr",
    "$expr": "$name | NUM | STR | TPL | RX | $expr MEM | $expr [ $list ] | $expr ( ) | $expr ( $args ) | $expr ?. ( $args ) | $expr ?. ( ) | $expr ?. [ $list ] | $expr TPL | ( $list ) | [ ] | [ $items ] | { } | { $props }"
    " | new $expr | $expr $binary $expr | $expr $assign $expr | $expr ? $expr : $expr | $unary $expr | $expr ++ | $expr -- | $arrow | $function | $class | await $expr | yield | yield $expr | yield * $expr | import ( $args ) | import MEM | new MEM",
    "$binary": " | ".join("\\" + x if x == "|" else x for x in BINARY),
    "$assign": " | ".join(ASSIGN),
    "$unary": "+ | - | ! | ~ | ++ | -- | typeof | void | delete",
    "$args": "$arg | $args , $arg | $args ,",
    "$arg": "$expr | ... $expr",
    "$items": "$arg | $items , $arg | $items , | , $arg | ,",
    "$props": "$prop | $props , $prop | $props ,",
    "$prop": "$name | $key : $expr | ... $expr | $name = $expr | $method",
    "$key": "$name | STR | NUM | [ $expr ] | default | delete | class | for | new | import | in | typeof | void | enum | export | function | if | return | do | with",
    "$method": "$key ( ) $block | $key ( $params ) $block | async $method | get $method | set $method | * $method | static $method",
    "$params": "$param | $params , $param | $params ,",
    "$param": "$pattern | $pattern = $expr | ... $pattern",
    "$arrow": "$name => $body | ( ) => $body | ( $params ) => $body | async $arrow",
    "$body": "$block | $expr",
    "$function": "function $sig $block | function $name $sig $block | function * $sig $block | function * $name $sig $block | async $function",
    "$sig": "( ) | ( $params )",
    "$class": "class $classbody | class $name $classbody | class $name extends $expr $classbody | class extends $expr $classbody | $decorator $class",
    "$classbody": "{ } | { $members }",
    "$members": "$member | $members $member",
    "$member": "$method | $field ; | $field | ; | static $field ; | static $block | $decorator $member | $method ;",
    "$field": "$key | $key = $expr",
    "$decorator": "@ $expr",
}

TYPES = {
    "$name": "type | interface | implements | private | public | protected | readonly | abstract | declare | namespace | module | keyof | is | infer | satisfies | asserts | override | unique | accessor",
    "$stmt": "$typed | export $typed | declare $stmt | export $stmt | abstract $class | export default $typed",
    "$typed": "interface $name { } | interface $name { $shape } | interface $name extends $types { $shape } | interface $name extends $types { } | interface $name $generics $inherit { $shape } | interface $name $generics { $shape } | type $name = $type ; | type $name = $type"
    " | type $name $generics = $type ; | enum $name { } | enum $name { $props } | const enum $name { $props } | namespace $dotted $block | module $dotted $block | module STR $block | abstract $class | declare $stmt | function $name $sig ; | export = $expr ; | import $name = $expr ;",
    "$dotted": "$name | $name MEM",
    "$inherit": "extends $types",
    "$import": "type { $specs } from STR | type $name from STR | type * as $name from STR",
    "$spec": "type $name | type $name as $name",
    "$export": "type { $specs } | type { $specs } from STR | type * from STR",
    "$shape": "$entry | $shape $entry | $shape ; $entry | $shape , $entry | $shape ; | $shape ,",
    "$entry": "$key : $type | $key ? : $type | readonly $entry | $key $sig : $type | $key ? $sig : $type | $key $generics $sig : $type | [ $name : $type ] : $type | [ $name in $type ] : $type | [ $name in $type ] ? : $type | [ $name as $type ] | $sig : $type | new $sig : $type | - readonly $entry | get $entry | set $entry | + readonly $entry",
    "$types": "$type | $types , $type",
    "$type": "$name | void | STR | NUM | TPL | - NUM | $type MEM | $type [ ] | $type [ $type ] | $name < $types > | $name MEM < $types > | { } | { $shape } | [ ] | [ $tuple ] | ( $type ) | $type | $sum | $type & $type | & $type | keyof $type | typeof $expr | readonly $type | infer $name"
    " | $fntype | $type extends $type ? $type : $type | $name is $type | asserts $name is $type | asserts $name | unique $name | import ( STR ) | new $fntype | infer $name extends $type | in $type | out $type | typeof $expr < $types >",
    "$sum": "$type \\| $type | \\| $type",
    "$tuple": "$type | $name : $type | $name ? : $type | ... $type | $type ? | $tuple , $tuple | $tuple ,",
    "$fntype": "$sig => $type | $generics $sig => $type",
    "$generics": "< $gparams >",
    "$gparams": "$gparam | $gparams , $gparam | $gparams ,",
    "$gparam": "$name | $name extends $type | $name = $type | $name extends $type = $type | const $gparam | in $gparam",
    "$bind": "$pattern : $type | $pattern : $type = $expr | $pattern ! : $type",
    "$param": "$pattern : $type | $pattern ? | $pattern ? : $type | $pattern : $type = $expr | $modifier $param | this : $type | ... $pattern : $type | $decorator $param",
    "$modifier": "private | public | protected | readonly | override",
    "$arrow": "( ) : $type => $body | ( $params ) : $type => $body | $generics $arrow",
    "$function": "function $tsig $block | function $name $tsig $block | function * $tsig $block | function * $name $tsig $block",
    "$tsig": "$sig : $type | $generics $sig | $generics $sig : $type",
    "$method": "$key $tsig $block | $key ? $sig $block | $modifiers $method",
    "$modifiers": "private | public | protected | readonly | abstract | override | static | declare | async | accessor",
    "$member": "$modifiers $member | $key $sig : $type ; | $key $tsig ; | $key $sig ; | [ $name : $type ] : $type ; | $key $sig : $type",
    "$field": "$key : $type | $key : $type = $expr | $key ? : $type | $key ! : $type | $key ?",
    "$class": "class $name $generics $classbody | class $name $generics extends $expr $classbody | class $name implements $types $classbody | class $name extends $expr implements $types $classbody | class $name $generics implements $types $classbody"
    " | class $name extends $expr < $types > $classbody | class $name extends $expr < $types > implements $types $classbody | class implements $types $classbody",
    "$expr": "$expr as $type | $expr satisfies $type | $expr ! | $expr < $types > ( ) | $expr < $types > ( $args ) | $expr as const | $expr < $types > TPL",
    "$handlers": "catch ( $pattern : $type ) $block",
}
CASTS = {"$expr": "< $type > $expr | < const > $expr"}
JSX = {
    "$expr": "$jsx",
    "$jsx": "JSELF | JTAG JCLOSE | JTAG $children JCLOSE",
    "$children": "$child | $children $child",
    "$child": "$jsx | JTEXT | { } | { $expr } | { ... $expr }",
}

LANGUAGES = {"js": (SCRIPT,), "jsx": (SCRIPT, JSX), "ts": (SCRIPT, TYPES, CASTS), "tsx": (SCRIPT, TYPES, JSX)}


def _rules(parts: tuple[dict[str, str], ...]) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for part in parts:
        for head, text in part.items():
            for alternative in text.replace("\\|", "\x00").split(" | "):
                out.setdefault(head, []).append([x.replace("\x00", "|") for x in alternative.split()])
    return out


def _adjacent(rules: dict, first: dict, last: dict, *, lists: bool) -> set[tuple[str, str]]:
    """Pairs made by the productions; ``lists`` tells whether plain repetition of statements and members,
    and what follows a decorator, counts: these may need a line end between them."""
    out = set()
    for head, alternatives in rules.items():
        for alternative in alternatives:
            repeats = head in ("$stmts", "$members", "$shape") and len(alternative) == 2 and alternative[0] == head
            if not lists and (repeats or alternative[0] == "$decorator"):
                continue
            for x, y in zip(alternative, alternative[1:], strict=False):
                out |= {(a, b) for a in (last[x] if x in rules else {x}) for b in (first[y] if y in rules else {y})}
    return out


@lru_cache
def permissible(language: str) -> frozenset[tuple[str, str, bool]]:
    """(left, right, across a line end) of all pairs the grammar of ``language`` allows."""
    rules = _rules(LANGUAGES[language])
    first: dict[str, set[str]] = {h: set() for h in rules}
    last: dict[str, set[str]] = {h: set() for h in rules}
    grown = True
    while grown:
        grown = False
        for head, alternatives in rules.items():
            for alternative in alternatives:
                for at, table in ((alternative[0], first), (alternative[-1], last)):
                    new = table[at] if at in rules else {at}
                    if not new <= table[head]:
                        table[head] |= new
                        grown = True
    listed = _adjacent(rules, first, last, lists=True)
    within = _adjacent(rules, first, last, lists=False)
    # on one line, a statement follows another only after a token that closes it
    closing = {";", "}"}
    same = within | {(a, b) for a, b in listed if a in closing}
    ends, begins = last["$stmt"] | last["$member"], first["$stmt"] | first["$member"]
    if "$entry" in rules:
        ends, begins = ends | last["$type"] | last["$entry"], begins | first["$entry"]
    across = listed | {(a, b) for a in ends for b in begins} | {(a, "}") for a in ends}
    return frozenset({(a, b, False) for a, b in same | {(a, "}") for a in ends}} | {(a, b, True) for a, b in across})
