"""Cleaning and shaping of program texts, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the program formats.
LITERAL = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
OPEN_LITERAL = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z))"""
MARK = "\u0001"
FENCE = "```"
CONTROL_WORDS = ("if", "else", "for", "while", "switch", "try", "catch")
LONGEST_OUTPUT = 10_000
EXCERPTS = {"snippet": 800, "prompt": 1500, "report": 400, "blocked": 1500}
#: Style hints in rotation, fixed values.
HINTS = (
    "STYLE HINT: Prefer unsigned integer types (unsigned int, unsigned long) as the primary data type.",
    "STYLE HINT: Prefer floating-point arithmetic (double or float) as the primary data type.",
    "STYLE HINT: Use std::string and string operations as the primary data type.",
    "STYLE HINT: Use nested loops (for, while, do-while) as the primary control structure.",
    "STYLE HINT: Express logic through local structs or classes with member variables.",
    "STYLE HINT: Use stack-allocated C-style arrays or std::array as the primary container.",
    "STYLE HINT: Use bit-manipulation operators (&, |, ^, <<, >>) prominently.",
    "STYLE HINT: Replace if-else with the ternary operator (?:) wherever possible.",
    "STYLE HINT: Use local lambdas that capture variables from the enclosing scope.",
    "STYLE HINT: Use raw pointer variables with address-of (&) and dereference (*) operations.",
)
#: Headers and the names that call for them, in order.
HEADERS = {
    "<cstring>": ["strcmp", "strlen", "strcpy", "strcat", "strncmp", "strncpy", "memcpy", "memmove", "memset", "memcmp", "strchr", "strstr", "strtok"],
    "<cstdio>": ["printf", "scanf", "fprintf", "sprintf", "sscanf", "fopen", "fclose", "fread", "fwrite", "fgets", "fputs", "puts", "FILE"],
    "<cstdlib>": ["malloc", "calloc", "realloc", "free", "rand", "srand", "atoi", "atof", "strtol", "strtod", "exit", "abort", "qsort"],
    "<cmath>": ["sqrt", "pow", "sin", "cos", "tan", "log", "exp", "floor", "ceil", "fabs", "fmod", "atan"],
    "<cassert>": ["assert"],
    "<cstdint>": ["int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t"],
    "<vector>": ["vector"],
    "<array>": ["std::array"],
    "<string>": ["std::string"],
    "<algorithm>": ["std::sort", "std::find", "std::transform", "std::for_each", "std::count", "lower_bound", "upper_bound", "std::binary_search", "std::copy", "std::fill", "std::reverse", "std::unique"],
    "<functional>": ["std::function", "std::bind"],
    "<numeric>": ["std::accumulate", "std::iota", "std::inner_product"],
    "<utility>": ["std::pair", "std::move", "std::swap", "std::make_pair"],
    "<type_traits>": ["std::is_same", "std::is_same_v", "std::enable_if"],
}
#: Names of source areas, fixed values.
CATEGORIES = {
    "gcc": "GCC core compiler (frontend, middle-end, backend, optimizers)",
    "libstdc++-v3": "C++ standard library implementation",
    "libgcc": "GCC low-level runtime library",
    "libiberty": "portability and utility library",
    "include": "GCC public headers",
    "fixincludes": "system header fixups",
}
#: What an island may be asked for, fixed values.
BIASES = {
    "memory_allocation": "emphasizing memory allocation patterns such as malloc/free, new/delete, RAII, unique_ptr, or custom allocators",
    "concurrency": "emphasizing thread-concurrency features such as mutex, std::thread, atomic operations, or coroutines",
    "arithmetic": "emphasizing arithmetic edge cases such as integer overflow, floating-point precision, bitwise operations, or mixed-type expressions",
    "template_meta": "emphasizing template metaprogramming, concepts, constexpr, or type traits",
    "error_handling": "emphasizing error-handling patterns such as exceptions, setjmp/longjmp, errno, or RAII guards",
}
#: The request for a program, fixed text.
SPEC = (
    "The {language} code below starts with {includes} already present. Write a COMPLETE, self-contained {language} program that includes its own `int main()` and exercises the following characteristics{note}.\n"
    "You MAY define top-level functions, classes, and templates, and add standard `#include` directives as needed. Use ONLY standard {language} headers/features -- do NOT use any compiler-internal headers, types, or APIs.\n"
    "Try to incorporate the following characteristics into the code:\n{text}\n"
    "IMPORTANT: {includes} is ALREADY written immediately after this comment -- continue directly from there with the rest of the program (you may add more `#include`s, then your definitions and `int main()`)."
)


def word(names: str | list[str] | tuple[str, ...]) -> str:
    """Pattern for any of the names as a whole ASCII word, whatever the dialect's idea of a word."""
    from re import escape

    names = names.split() if isinstance(names, str) else names
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(map(escape, names)) + r")(?![A-Za-z0-9_])"


def strip_c_comments(c: Column) -> Column:
    """Line and block comments become one space each, string and character literals stay."""
    c = F.regexp_replace(c, rf"(?smd){LITERAL}|//.*?$|/\*.*?\*/", f"$1{MARK}")
    c = F.regexp_replace(c, rf"(?s){LITERAL}{MARK}", "$1")
    return F.replace(c, F.lit(MARK), F.lit(" "))


def strip_smt_comments(c: Column) -> Column:
    """From a semicolon to the end of its line."""
    return F.regexp_replace(c, r";[^\n]*", "")


def strip_python_comments(c: Column) -> Column:
    """From # to the end of its line, then text between triple quotes of either kind."""
    c = F.regexp_replace(c, r"#[^\n]*", "")
    c = F.regexp_replace(c, r'(?s)""".*?"""', "")
    return F.regexp_replace(c, r"(?s)'''.*?'''", "")


def strip_comments(c: Column, language: Column) -> Column:
    """By language; an unknown one leaves the text as it is."""
    return (
        F.when(language.isin("cpp", "c", "go", "java"), strip_c_comments(c))
        .when(language == "smt2", strip_smt_comments(c))
        .when(language.isin("python", "qiskit"), strip_python_comments(c))
        .otherwise(c)
    )


def fenced(c: Column) -> Column:
    """What the first code fence holds, less its first line; empty without a fence."""
    inner = F.get(F.split(c, FENCE), F.lit(1))
    return F.coalesce(F.when(F.instr(inner, "\n") > 0, F.substr(inner, F.instr(inner, "\n") + 1)), F.lit(""))


#: A main function, opened; fixed patterns.
OPENED_MAIN = r"int\s+main\s*\([^;{]*\)\s*\{\s*\z"
ECHOED = r"^(?:#include\s*<[^>]+>\s*)*\s*int\s+main\s*\(\s*\)\s*\{"
OWN_MAIN = r"(?m)^[ \t]*int\s+main\s*\([^;{]*\)\s*\{"


def mend_scaffold(c: Column, begin: str) -> Column:
    """If the scaffold opens a main, an echo of it after itself goes; where a whole program follows instead, the
    scaffold keeps its header alone. `c` starts with `begin`."""
    from re import search, sub

    if not search(OPENED_MAIN.replace(r"\z", r"\Z"), begin.rstrip()):
        return c
    after = F.regexp_replace(F.substr(c, F.lit(len(begin) + 1)), r"^\n+", "")
    header = sub(r"int\s+main\s*\(\s*\)\s*\{\s*\Z", "", begin).rstrip()
    echo = F.regexp_like(after, F.lit(ECHOED))
    return (
        F.when(echo, F.concat(F.lit(begin + "\n"), F.regexp_replace(after, "(?s)" + ECHOED + "(.*)", "$1")))
        .when(F.regexp_like(after, F.lit(OWN_MAIN)), F.concat(F.lit(header + "\n"), after))
        .otherwise(c)
    )


def drop_lines(c: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def drop_blank_lines(c: Column) -> Column:
    return drop_lines(c, lambda x: F.regexp_like(x, F.lit(r"\S")))


def clean(c: Column, language: Column) -> Column:
    """Comments out, and for smt2 the option and proof lines; cpp has its braces closed."""
    smt = drop_lines(strip_smt_comments(c), lambda x: ~x.startswith("(set-option :") & ~x.startswith("(get-proof)"))
    return F.when(language == "cpp", close_braces(strip_c_comments(c))).when(language == "smt2", smt).otherwise(strip_comments(c, language))


def clean_code(c: Column, language: Column, begin: str = "") -> Column:
    """Comments and blank lines out, and lines that echo the scaffold `begin`: the whole of it for most
    languages, any of its lines for cpp; go and qiskit lose its text first."""
    own = [x.strip() for x in begin.splitlines() if x.strip()]
    cut = F.when(language.isin("go", "qiskit") & F.lit(bool(begin)), F.replace(c, F.lit(begin or "\u0001"), F.lit(""))).otherwise(c)
    lines = F.filter(F.split(strip_comments(cut, language), "\n"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    echo = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "").isin(own) if own else F.lit(False)
    whole = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "") == begin.strip() if begin else F.lit(False)
    kept = F.when(language == "cpp", F.filter(lines, lambda x: ~echo(x))).otherwise(F.filter(lines, lambda x: ~whole(x)))
    return F.array_join(kept, "\n")


def open_braces(c: Column) -> Column:
    """Depth of braces left open at the end; a closing one never takes it below nothing."""
    only = F.regexp_replace(F.regexp_replace(c, f"(?s){OPEN_LITERAL}", ""), r"[^{}]+", "")
    return F.aggregate(F.split(only, ""), F.lit(0), lambda n, x: F.when(x == "{", n + 1).when(x == "}", F.greatest(n - 1, F.lit(0))).otherwise(n))


def close_braces(c: Column) -> Column:
    """A closing brace on its own line for each that is left open."""
    n = open_braces(c)
    return F.when(n > 0, F.concat(F.regexp_replace(c, r"\s+\z", ""), F.lit("\n"), F.repeat(F.lit("}\n"), n))).otherwise(c)


def cut_at_stops(c: Column, stops: list[str], most: int = LONGEST_OUTPUT) -> Column:
    """Up to the earliest stop string, and `most` characters at most."""
    at = [F.coalesce(F.nullif(F.locate(s, c), F.lit(0)) - 1, F.lit(most)) for s in stops]
    return F.left(c, F.least(F.lit(most), *at) if at else F.lit(most))


def all_stopped(texts: Column, stops: list[str]) -> Column:
    """X11: every text of the array holds one of the stop strings."""
    return F.forall(texts, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in stops]))


def complexity(c: Column, language: Column) -> Column:
    """Control words of C-like text, deepest indent in fours for Python. Only places with a control word's first
    letter are looked at further."""
    indent = F.array_max(F.transform(F.split(c, "\n"), lambda x: F.floor(F.length(F.regexp_extract(x, r"^(\s*)", 1)) / 4)))
    control = f"(?=[{''.join(sorted({w[0] for w in CONTROL_WORDS}))}])" + word(CONTROL_WORDS)
    return F.when(language.isin("python", "qiskit"), indent).otherwise(F.regexp_count(c, F.lit(control))).cast("long")


def category(path: Column) -> Column:
    """The first part of the path, by its known name."""
    top = F.split_part(path, F.lit("/"), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, top), top)


def any_of(names: list[str]) -> str:
    """Pattern for any of the names, those with the same beginning together, so that few are tried at a place."""
    from re import escape

    tails: dict[str, list[str]] = {}
    for n in names:
        tails.setdefault(n[:1], []).append(n[1:])
    more = "|".join(escape(x) + any_of(own) for x, own in tails.items() if x)
    return f"(?:{more})" + ("?" if "" in tails else "") if more else ""


def needed_headers(c: Column) -> Column:
    """Headers whose names the text has as whole words, in the table's order. All names are looked for in one pass;
    none has another one in it as a whole word."""
    places = {n: i for i, names in enumerate(HEADERS.values(), 1) for n in names}
    named = rf"(?<![A-Za-z0-9_])({any_of(list(places))})(?![A-Za-z0-9_])"
    place = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(named), 1), lambda w: F.element_at(place, w))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda i: F.element_at(F.array(*map(F.lit, HEADERS)), i))


def with_headers(begin: Column, headers: Column) -> Column:
    """A scaffold with an include line for each header that it lacks, above its main or, without one, at its end."""

    def insert(acc: Column, h: Column) -> Column:
        line = F.concat(F.lit("#include "), h)
        at = F.instr(acc, "int main")
        above = F.concat(F.left(acc, at - 1), line, F.lit("\n"), F.substr(acc, at))
        return F.when(F.contains(acc, line), acc).when(at > 0, above).otherwise(F.concat(F.regexp_replace(acc, r"\s+\z", ""), F.lit("\n"), line))

    return F.aggregate(F.array_sort(F.array_distinct(headers)), begin, insert)


def chat(system: Column, *said: tuple[str, Column]) -> Column:
    """An array of role and content, the system's first; turns whose content is null are left out."""
    turns = F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", system), *said)])
    return F.filter(turns, lambda t: t["content"].isNotNull())


def example_chat(system: Column, docstring: Column, example: Column, ask: Column, first: Column) -> Column:
    """Documentation, an example, and after a first answer the question once more."""
    answered = F.coalesce(first, F.lit("")) != ""
    return chat(system, ("user", docstring), ("user", example), ("user", F.when(answered, ask)), ("assistant", F.when(answered, F.concat(F.lit("```\n"), first, F.lit("\n```")))), ("user", ask))


def render_spec(text: Column, area: Column, language: str = "cpp") -> Column:
    """The request for a program with these characteristics, naming the headers they need."""
    extra = needed_headers(text) if language in ("cpp", "c") else F.array().cast("array<string>")
    includes = F.array_join(F.transform(F.concat(F.array(F.lit("<iostream>")), extra), lambda h: F.concat(F.lit("`#include "), h, F.lit("`"))), ", ")
    note = F.when(F.coalesce(area, F.lit("")) != "", F.concat(F.lit(" (inspired by the compiler's "), area, F.lit(" pass)"))).otherwise("")
    out = F.lit(SPEC.replace("{language}", language))
    for name, c in (("{includes}", includes), ("{note}", note), ("{text}", text)):
        out = F.replace(out, F.lit(name), c)
    return out


def with_hint(spec: Column, i: Column) -> Column:
    """The i-th hint, in rotation, after the spec."""
    return F.concat(spec, F.lit("\n"), F.element_at(F.array(*map(F.lit, HINTS)), (F.pmod(i, F.lit(len(HINTS))) + 1).cast("int")))


def spec_index(i: Column, n: int, interval: int = 50) -> Column:
    """Which of n specs is active at iteration i; an interval of 0 never rotates."""
    return F.lit(0).cast("long") if interval == 0 else F.floor(i / interval) % n


def hint_index(i: Column, batch: int = 5) -> Column:
    return F.floor(i / batch) % len(HINTS)


def bullets(c: Column) -> Column:
    """The texts of the lines that start with - or *."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    own = F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* "))
    return F.filter(F.transform(own, lambda x: F.regexp_replace(F.substr(x, F.lit(3)), r"^\s+|\s+$", "")), lambda x: x != "")


def wrap_prompt(c: Column, language: Column, separator: str = "", begin: str = "") -> Column:
    """The prompt as a comment of its language, then separator and scaffold."""
    said = (
        F.when(language.isin("cpp", "c", "java"), F.concat(F.lit("/* "), c, F.lit(" */")))
        .when(language == "go", F.concat(F.lit("// "), c))
        .when(language == "smt2", F.concat(F.lit("; "), c))
        .when(language.isin("qiskit", "python"), F.concat(F.lit("'''"), c, F.lit("'''")))
        .otherwise(c)
    )
    return F.concat(said, F.lit(f"\n{separator}\n{begin}"))


def as_comment(c: Column, language: Column) -> Column:
    """Every line behind the language's line comment, or the whole in a block."""
    lines = lambda mark: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")
    return F.when(language == "smt2", lines("; ")).when(language.isin("python", "qiskit"), lines("# ")).otherwise(F.concat(F.lit("/* "), c, F.lit(" */")))


def swap_base(base: Column, spec: Column, language: Column) -> Column:
    """The constraint comment before the saved base; made from the base each time, so it never stacks."""
    return F.concat(as_comment(spec, language), F.lit("\n"), base)


def strategy(pick: Column, previous: Column) -> Column:
    """New, mutate, equivalent or combine by a pick of 0 to 3; a combination without a previous example is
    picked anew, here as a new program. A negative pick asks for none."""
    return F.when(pick == 1, "mutate").when(pick == 2, "equivalent").when((pick == 3) & previous.isNotNull(), "combine").when(pick >= 0, "new")


def cloze_prompt(masked: Column, language: Column) -> Column:
    """The request to fill a masked program in; fixed text."""
    return F.concat(
        F.lit("The following "), language, F.lit(' program has some tokens replaced with "___MASK___". Fill in each blank with a syntactically and semantically valid replacement that preserves program structure. Return ONLY the completed program with no explanation.\n\n```'),
        language, F.lit("\n"), masked, F.lit("\n```"),
    )


def bias_sentence(bias: Column, known: dict[str, str] = BIASES) -> Column:
    """What a known bias asks for, else the bias itself, as a sentence."""
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), bias), bias)
    return F.concat(F.lit("When generating code, focus on "), said, F.lit("."))


#: Marks spliced programs; a caller may ask for another comment.
SPLICED = "/* constraint-solver generated */\n"


def splice(base: Column, snippet: Column, language: Column, head: str = SPLICED) -> Column:
    """A solution as a program of its language; a blank one leaves the base."""
    s = F.regexp_replace(snippet, r"^\s+|\s+$", "")
    head = F.lit(head)
    c = F.when(F.regexp_like(s, F.lit(r"(?<![A-Za-z0-9_])main\s*\(")), F.concat(head, s)).otherwise(F.concat(head, F.lit("int main(void) {\n"), s, F.lit("\nreturn 0;\n}\n")))
    java = F.when(F.contains(s, F.lit("class ")) & F.contains(s, F.lit("main")), F.concat(head, s)).otherwise(
        F.concat(head, F.lit("public class SolverGenerated {\n  public static void main(String[] args) {\n    "), s, F.lit("\n  }\n}\n"))
    )
    go = F.when(s.startswith("package "), F.concat(head, s)).otherwise(F.concat(head, F.lit("package main\n\nfunc main() {\n"), s, F.lit("\n}\n")))
    return F.when(s == "", base).when(language.isin("cpp", "c"), c).when(language == "java", java).when(language == "go", go).otherwise(F.concat(head, base, F.lit("\n"), s))


def context_lines(c: Column, line: Column, radius: int = 10) -> Column:
    """The lines around a 1-based line: from radius + 1 before it to radius after it, cut to the text."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    at = F.coalesce(line, F.lit(1))
    first = F.greatest(at - radius - 1, F.lit(0))
    last = F.least(at + radius, F.size(lines))
    return F.array_join(F.slice(lines, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), "\n")


def natural_key(c: Column) -> Column:
    """Digits as numbers, before other text, which is lower-cased, in turn, for sorting."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    n = lambda x: x.try_cast("decimal(38,0)")
    return F.transform(parts, lambda x: F.struct(n(x).isNull().alias("text"), n(x).alias("n"), F.when(n(x).isNull(), F.lower(x)).alias("s")))


def natural_text(c: Column) -> Column:
    """X29 as a text that sorts like natural_key(): numbers by length and digits, before other text."""
    number = lambda x: F.regexp_replace(x, "^0+", "")
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    shown = lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]")), F.concat(F.lit("0"), F.lpad(F.length(number(x)).cast("string"), 10, "0"), number(x))).otherwise(F.concat(F.lit("1"), F.lower(x)))
    return F.array_join(F.transform(parts, shown), "\u0001")


def backend(model: Column) -> Column:
    """Local models carry a prefix; the name follows it."""
    return F.struct(F.startswith(model, F.lit("ollama/")).alias("local"), F.when(F.startswith(model, F.lit("ollama/")), F.substr(model, F.lit(8))).otherwise(model).alias("name"))


def drop_last_line(c: Column) -> Column:
    """X31."""
    lines = F.split(c, "\n")
    return F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n")


def smt_result(c: Column) -> Column:
    """Invalid model before unknown or unsupported, before the first sat or unsat line; else empty."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.get(F.filter(lines, lambda x: x.isin("sat", "unsat")), F.lit(0))
    return (
        F.when(F.exists(lines, lambda x: F.contains(x, F.lit("an invalid model was generated"))), "invalid model")
        .when(F.exists(lines, lambda x: x.isin("unknown", "unsupported")), "unknown")
        .otherwise(F.coalesce(first, F.lit("")))
    )


def promoted_text(c: Column, api: Column, begin: str = "") -> Column:
    """an api that is null asks for nothing, else it must occur once the scaffold is out."""
    return api.isNull() | (F.instr(F.regexp_replace(F.replace(c, F.lit(begin or "\u0001"), F.lit("")), r"^\s+|\s+$", ""), api) > 0)


#: Types of the compiler's back end in a signature, fixed values.
LOW_LEVEL = [
    "rtx",
    "rtx_code",
    "machine_mode",
    "HARD_REG_SET",
    "reg_class",
    "bitmap_iterator",
    "sbitmap",
    "bitmap_head",
    "ira_allocno",
    "ira_object",
    "ira_loop",
    "df_ref",
    "df_mw_hardreg",
    "gimple_stmt_iterator",
    "gsi_iterator",
    "opt_pass",
    "pass_manager",
    "sreal",
    "bb_info",
]


def translatable(snippet: Column, denied: str | list[str] = LOW_LEVEL) -> Column:
    """no denied word before the first brace, or in the first 400 characters without one."""
    sig = F.when(F.instr(snippet, "{") > 0, F.left(snippet, F.instr(snippet, "{") - 1)).otherwise(F.left(snippet, F.lit(400)))
    return ~F.regexp_like(sig, F.lit(word(denied)))


def newest_standard(help_text: Column) -> Column:
    """Of the -std=c++NN of a help text the newest, years from 89 on being of the last century."""
    years = F.transform(F.regexp_extract_all(help_text, F.lit(r"-std=c\+\+([0-9]{2})(?![0-9A-Za-z])"), 1), lambda y: y.cast("int") + F.when(y.cast("int") >= 89, 1900).otherwise(2000))
    return F.array_max(years)


def next_link(header: Column) -> Column:
    """The URL of the part of a Link header that says rel="next"."""
    parts = F.transform(F.split(header, ","), lambda p: F.split(p, ";"))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & F.contains(F.get(p, F.lit(1)), F.lit('rel="next"')))
    return F.regexp_replace(F.get(F.get(good, F.lit(0)), F.lit(0)), r"^[\s<]+|[\s>]+$", "")


def class_file(c: Column) -> Column:
    """K3: the public class names the file, else a fixed name."""
    name = F.regexp_extract(c, r"public\s+class\s+([^\s{]+)", 1)
    return F.concat(F.when(name != "", name).otherwise("Main"), F.lit(".java"))
