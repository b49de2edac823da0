"""Code blocks in answers: extraction, environment routing, packages."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions import lexers
from verdictframe.functions.predicates import squeeze

# Fence pattern, low-priority tags, language prefixes, patterns.
FENCE = r"(?s)```([\w+#\-.]*)[ \t]*\r?\n?(.*?)```"
LOW_PRIORITY = ["bash", "shell", "sh", "zsh", "powershell", "pwsh", ""]
PYTHON_PREFIXES = ["py", "ipython", "pygame", "gradio", "streamlit"]
VUE_PREFIXES = ["vue"]
REACT_PREFIXES = ["react", "next"]
JS_PREFIXES = ["js", "javascript", "jsx", "coffee", "ecma", "node", "es", "svelte"]
HTML_PREFIXES = ["html", "xhtml", "htm"]
TS_PREFIXES = ["ts", "typescript", "tsx"]
MERMAID_PREFIXES = ["mermaid", "mmd"]
CPP_PREFIXES = ["cpp", "c++"]
GO_PREFIXES = ["go", "golang"]
JAVA_PREFIXES = ["java"]
RUST_PREFIXES = ["rust"]
ENVIRONMENTS = [
    "Auto", "HTML", "React", "Vue", "Gradio", "Streamlit", "PyGame", "Mermaid",
    "Python Runner", "Javascript Runner", "C Runner", "C++ Runner", "Java Runner",
    "Rust Runner", "Golang Runner",
]
PYTHON_IMPORT = r"(?m)(?:^|[;:])[ \t]*import[ \t]+([^\n;]+)"
PYTHON_FROM = r"(?m)(?:^|[;:])[ \t]*from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b"
VUE_TEMPLATE_PATTERNS = [
    r"\bv-(if|else|for|bind|on|model|show|html|text)=",
    r"@(?:click|change|input|submit|keyup|keydown)\s*=",
    r":(?:class|style|src|href|value|disabled|checked)\s*=",
]
VUE_PATTERNS = [
    r"export\s+default\s+\{[\s\S]*?(components|props|emits|data|methods|computed|watch)\s*:",
    r"defineComponent\s*\(",
    r"Vue\.extend\s*\(",
    r"createApp\s*\(",
    r"\b(ref|reactive|computed|watch|onMounted|onUnmounted|provide|inject)\s*\(",
    r"defineProps\s*\(",
    r"defineEmits\s*\(",
    r"<[a-zA-Z][^>]+\s+(v-(if|else|for|bind|on|model|show|html|text)|@|:)[^>]*>",
]
JSX_ELEMENT = r"(?:return|=>|\(|=)\s*<[A-Za-z][\w.]*[\s/>]"
TYPESCRIPT_FORMS = [
    r"\binterface\s+\w+[^{]*\{",
    r"(?m)^\s*(?:export\s+)?type\s+\w+\s*(?:<[^>]*>)?\s*=",
    r"\benum\s+\w+\s*\{",
    r"\b(?:const|let|var)\s+\w+\s*:\s*\w+",
    r"[(,]\s*\w+\??\s*:\s*(?:string|number|boolean|any|unknown|void|never|[A-Z]\w*)\b",
    r"\)\s*:\s*(?:string|number|boolean|any|unknown|void|never|[A-Z]\w*)\b",
    r"\bimplements\s+\w+",
    r"\b(?:private|protected|public|readonly)\s+\w+",
    r"\bdeclare\s+(?:const|let|var|function|class|module|namespace|global|enum)\b",
    r"(?m)^\s*@[A-Za-z_]\w*(?:\([^()]*\))?\s*(?:export\s+)?(?:abstract\s+)?class\b",
    r"\b(?:Array|Promise|Map|Set|Record|Partial|useState|useRef)<[\w\s,.<>\[\]|]+>",
]
SCRIPT_URL = r"""(?i)<script[^>]*src="https?://([^"]+)"[^>]*>"""
# Folders under which each content network keeps its packages.
CDN_FOLDERS = {"unpkg.com": [], "cdn.jsdelivr.net": ["npm"]}
INLINE_SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
MODULE_URL = r"""import\s+[\w\s{},*]+\s+from\s+['"]https?://[^/]+/npm/([^/@"\s]+)[@/][^"]*['"]"""
ANY_MODULE_URL = r"""import\s+[\w\s{},*]+\s+from\s+['"]https?://[^"]+['"]"""
CDN_PATH_WORDS = ["npm", "dist", "lib", "build", "umd", "esm", "cjs", "min"]
INLINE_PIP = (
    r"[#!]\s*(?:pip|pip3|python -m pip)\s+install\s+"
    r"(?:(?:--upgrade|--user|--no-cache-dir|-U)\s+)*"
    r"([^-\s][\w\-\[\]<>=~.]+(?:\s+[^-\s][\w\-\[\]<>=~.]+)*)"
)
# A name that is no attribute, no import alias and no keyword of a call.
SHORT_NAME = r"(?<![\w.])(?<!\bas\s{{1,8}}){name}\b(?!\s*=[^=].*[,)])"
PLACEHOLDER = r"/api/placeholder/(\d+)/(\d+)"
JAVA_CLASS = r"public\s+class\s+(\w+)"

# Modules that Python dropped after 3.11, and those it got later: the list is that of 3.11 under any version.
DROPPED = """aifc asynchat asyncore audioop cgi cgitb chunk crypt distutils imghdr imp lib2to3 mailcap msilib nis nntplib
 ossaudiodev pipes smtpd sndhdr spwd sunau telnetlib uu xdrlib""".split()
LATER = ["annotationlib", "compression", "pathlib._abc"]


def standard_library() -> list[str]:
    """Top-level modules that are no packages."""
    later = {n for n in sys.stdlib_module_names if n in LATER or n.startswith("_")}
    return sorted((set(sys.stdlib_module_names) - later) | set(DROPPED) | {"__future__"})


STDLIB = standard_library()


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fenced_blocks(answer: Column) -> Column:
    """ARRAY of (lang, code) for every fenced block, in order."""
    langs = F.regexp_extract_all(answer, F.lit(FENCE), 1)
    codes = F.regexp_extract_all(answer, F.lit(FENCE), 2)
    return F.transform(
        F.arrays_zip(langs.alias("lang"), codes.alias("code")),
        lambda b: F.struct(F.lower(b["lang"]).alias("lang"), b["code"].alias("code")),
    )


def main_block(blocks: Column) -> Column:
    """The longest stripped block in a real language, else the longest raw block.

    Shell and untagged blocks have low priority; the first of equals wins; NULL
    without any block.
    """

    def ranked(block: Column, i: Column) -> Column:
        size = F.length(squeeze(block["code"]))
        real = ~block["lang"].isin(LOW_PRIORITY) & (size > 0)
        return F.struct(
            real.cast("int").alias("real"),
            F.when(real, size).otherwise(F.length(block["code"])).alias("size"),
            (-i).alias("first"),
            block["lang"].alias("lang"),
            squeeze(block["code"]).alias("code"),
        )

    return F.array_max(F.transform(blocks, ranked))


def starts_with_any(column: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | column.startswith(prefix)
    return test


def contains_any(column: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | column.contains(word)
    return test


def matches_any(column: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | column.rlike(pattern)
    return test


# ------------------------------------------------------------------ packages

def python_imports(code: Column, stdlib: list[str] = STDLIB) -> Column:
    """Distinct top-level packages outside the standard library that code imports; comments and strings import nothing."""
    bare = lexers.python_code_only(code)
    lists = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(PYTHON_IMPORT), 1), lambda s: F.split(s, ",")))
    direct = F.transform(lists, lambda s: F.regexp_extract(s, r"^\s*(\w+)", 1))
    modules = F.concat(F.regexp_extract_all(bare, F.lit(PYTHON_FROM), 1), lexers.python_import_calls(code))
    names = F.filter(F.array_union(direct, F.transform(modules, lambda s: F.split(s, r"\.")[0])), lambda s: s != "")
    return F.array_except(names, _lit_array(stdlib))


def npm_package(path: Column) -> Column:
    """Package of an import path; scoped packages keep two parts."""
    parts = F.split(path, "/")
    return F.when(path.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def npm_imports(code: Column) -> Column:
    """Distinct npm packages that code imports; relative, absolute and aliased paths and URLs are none.

    A Vue single-file component is read from its first script section.
    """
    section = F.regexp_extract(code, r"(?s)<script.*?>(.*?)</script>", 1)
    source = F.when(code.contains("<script") & code.rlike(r"(?s)<script.*?>.*?</script>"), section).otherwise(code)
    paths = F.filter(
        lexers.script_modules(source),
        lambda p: ~(p.startswith(".") | p.startswith("/") | p.startswith("@/") | p.contains("://")),
    )
    return F.array_distinct(F.transform(paths, npm_package))


def _package_of(path: Column) -> Column:
    """Package that a list of path segments begins with; a scoped one has two segments."""
    first = F.get(path, F.lit(0))
    scoped = F.array_join(F.slice(path, 1, 2), "/")
    return F.when(first.startswith("@"), scoped).otherwise(F.split(first, "@")[0])


def _under(segments: Column, host: str, folders: list[str]) -> Column:
    """What follows the package folder of a content network; empty for other URLs."""
    depth = 1 + len(folders)
    here = F.lower(F.array_join(F.slice(segments, 1, depth), "/")) == "/".join([host, *folders])
    return F.when(here, F.slice(segments, depth + 1, F.size(segments))).otherwise(F.slice(segments, 1, 0))


def cdn_packages(html: Column) -> Column:
    """Distinct packages of script-tag URLs, version and path removed.

    Three sources: the package folders of the two content networks, and for any
    URL without a build folder on its way the first path segment that starts
    like a name.
    """
    urls = F.transform(F.regexp_extract_all(html, F.lit(SCRIPT_URL), 1), lambda u: F.split(u, "/"))
    networks = [
        F.transform(urls, in_network(host, folders)) for host, folders in CDN_FOLDERS.items()
    ]

    def folders_of(segments: Column) -> Column:
        return F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))

    plain = F.filter(
        urls, lambda u: ~F.exists(folders_of(u), lambda folder: F.lower(folder).isin(CDN_PATH_WORDS))
    )
    starts = F.transform(
        plain,
        lambda u: F.get(
            F.filter(
                F.transform(F.slice(u, 2, F.size(u)), lambda part: F.regexp_extract(part, r"^@?[\w-]+", 0)),
                lambda name: name != "",
            ),
            F.lit(0),
        ),
    )
    names = F.filter(
        F.concat(*networks, F.filter(starts, lambda name: name.isNotNull())),
        lambda name: name.isNotNull() & (name != "") & ~F.lower(name).isin(CDN_PATH_WORDS),
    )
    return F.array_distinct(names)


def in_network(host: str, folders: list[str]):
    return lambda segments: _package_of(_under(segments, host, folders))


def script_tag_packages(html: Column) -> Column:
    """Packages of an HTML page: CDN tags, and imports of its inline scripts.

    An inline script importing from a CDN names those packages; any other is
    read like a script file, URL imports left out.
    """

    none = F.array().cast("array<string>")

    def inline(script: Column) -> Column:
        modules = F.regexp_extract_all(script, F.lit(MODULE_URL), 1)
        local = npm_imports(F.regexp_replace(script, ANY_MODULE_URL, ""))
        return F.when(F.size(modules) > 0, modules).otherwise(local)

    scripts = F.regexp_extract_all(html, F.lit(INLINE_SCRIPT), 1)
    found = F.array_union(cdn_packages(html), F.flatten(F.transform(scripts, inline)))
    return F.when(F.lower(html).contains("<script"), found).otherwise(none)


# A word may hold quoted parts with blanks; the quotes themselves go.
WORD = r"""(?:"[^"]*"|'[^']*'|[^\s"'])+"""


def _words(text: Column, keep_quotes: bool) -> Column:
    if keep_quotes:
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return F.transform(words, lambda w: F.regexp_replace(w, r"""["']""", ""))


def _after(line: Column, word: str) -> Column:
    """Text after the first occurrence of ``word``."""
    return F.substring(line, F.locate(word, line) + len(word), F.length(line))


def install_packages(code: Column) -> tuple[Column, Column]:
    """(python, npm) packages named by install lines, versions kept.

    Flags are skipped, comments ignored, order kept, repeats dropped.
    """
    lines = F.filter(
        F.transform(F.split(code, "\n"), squeeze), lambda s: (s != "") & ~s.startswith("#")
    )

    def is_pip(line: Column) -> Column:
        return contains_any(line, ["pip install", "pip3 install"])

    def is_npm(line: Column) -> Column:
        return ~is_pip(line) & contains_any(line, ["npm install", "npm i", "yarn add"])

    def npm_tail(line: Column) -> Column:
        return (
            F.when(line.contains("yarn add"), _after(line, "add"))
            .when(line.contains("install"), _after(line, "install"))
            .otherwise(_after(line, "i"))
        )

    pip_words = F.flatten(
        F.transform(F.filter(lines, is_pip), lambda s: _words(_after(s, "install"), False))
    )
    npm_words = F.flatten(
        F.transform(F.filter(lines, is_npm), lambda s: _words(npm_tail(s), True))
    )
    python = F.filter(pip_words, lambda w: (w != "") & ~w.startswith("-"))
    npm = F.filter(
        npm_words, lambda w: ~w.startswith("-") & ~w.isin("npm", "install", "i", "add")
    )
    return F.array_distinct(python), F.array_distinct(npm)


def inline_pip_packages(code: Column) -> Column:
    """Packages of ``# pip install`` and ``!pip install`` remarks, without versions.

    Each line counts once, so the pattern is applied per line.
    """
    lines = F.split(code, r"\r\n|\r|\n")
    lists = F.transform(
        F.filter(lines, lambda s: s.rlike(INLINE_PIP)), lambda s: F.regexp_extract(s, INLINE_PIP, 1)
    )
    words = F.flatten(F.transform(lists, lambda s: F.split(s, r"\s+")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"(?:==|>=|<=|~=).*$", ""))
    return F.array_distinct(bare)


def without_inline_pip(code: Column) -> Column:
    """Code without those remarks; a line left blank by the removal goes."""
    lines = F.split(code, r"\r\n|\r|\n")

    def cut(line: Column) -> Column:
        kept = F.regexp_replace(F.regexp_replace(line, f"(?s){INLINE_PIP}.*$", ""), r"\s+$", "")
        return F.when(line.rlike(INLINE_PIP), F.nullif(kept, F.lit(""))).otherwise(line)

    return F.array_join(F.filter(F.transform(lines, cut), lambda s: s.isNotNull()), "\n")


# -------------------------------------------------------------- environments

def python_environment(code: Column, imports: Column, install: Column | None = None) -> Column:
    """Gradio or Streamlit by the short names, else by import, else the runner.

    Of the names ``gr`` and ``st`` the one earlier in the text decides; attributes, import aliases, keywords
    of calls, comments and strings are no names. The optional install command is searched for package names.
    """
    bare = lexers.python_code_only(code)
    gr, st = (F.regexp_instr(bare, F.lit(SHORT_NAME.format(name=name))) for name in ("gr", "st"))

    def imported(name: str) -> Column:
        hit = F.array_contains(imports, name)
        return hit if install is None else hit | F.coalesce(install.contains(name), F.lit(False))

    return (
        F.when((gr > 0) & ((st == 0) | (gr < st)), "Gradio")
        .when(st > 0, "Streamlit")
        .when(imported("pygame"), "PyGame")
        .when(imported("gradio"), "Gradio")
        .when(imported("streamlit"), "Streamlit")
        .otherwise("Python Runner")
    )


def script_environment(code: Column, imports: Column) -> Column:
    """Vue or React by template, import or pattern, else the JavaScript runner."""
    react = F.arrays_overlap(imports, _lit_array(["react", "@react", "next", "@next"]))
    vue = F.arrays_overlap(imports, _lit_array(["vue", "@vue", "nuxt", "@nuxt"]))
    return (
        F.when(contains_any(code, ["<template>", "<script setup"]), "Vue")
        .when(react, "React")
        .when(vue, "Vue")
        .when(lexers.script_code_only(code).rlike(JSX_ELEMENT), "React")
        .when(F.exists(lexers.script_templates(code), lambda t: matches_any(t, VUE_TEMPLATE_PATTERNS)), "Vue")
        .when(matches_any(code, VUE_PATTERNS), "Vue")
        .otherwise("Javascript Runner")
    )


def script_language(code: Column) -> Column:
    """typescript where a typed form occurs outside comments and strings, else javascript."""
    tagged = contains_any(code, ['<script lang="ts">', '<script lang="typescript">'])
    return F.when(tagged | matches_any(lexers.script_code_only(code), TYPESCRIPT_FORMS), "typescript").otherwise("javascript")


def is_html_document(lang: Column, code: Column) -> Column:
    page = code.contains("<!DOCTYPE html>")
    scripted = starts_with_any(lang, REACT_PREFIXES + VUE_PREFIXES + JS_PREFIXES + TS_PREFIXES)
    return (
        (page & contains_any(code, ["<head", "<body"]))
        | code.startswith("<svg")
        | (~scripted & (code.contains("<html") | page))
    )


def route(lang: Column, code: Column) -> tuple[Column, Column]:
    """(environment, language label) of a block, in fixed order of tests.

    Prefix tests come in order, so json counts as JavaScript and c++ is tested
    before the exact tag c. An unknown tag has no environment.
    """
    python = starts_with_any(lang, PYTHON_PREFIXES)
    vue = starts_with_any(lang, VUE_PREFIXES)
    react = starts_with_any(lang, REACT_PREFIXES)
    html_doc = is_html_document(lang, code)
    js = starts_with_any(lang, JS_PREFIXES)
    ts = starts_with_any(lang, TS_PREFIXES)
    html = starts_with_any(lang, HTML_PREFIXES)
    packages = npm_imports(code)
    scripted = script_environment(code, packages)
    compiled = [
        (MERMAID_PREFIXES, "Mermaid", "markdown"),
        (CPP_PREFIXES, "C++ Runner", "cpp"),
        (GO_PREFIXES, "Golang Runner", "go"),
        (JAVA_PREFIXES, "Java Runner", "java"),
        (RUST_PREFIXES, "Rust Runner", "rust"),
    ]
    environment = (
        F.when(python, python_environment(code, python_imports(code)))
        .when(vue, "Vue").when(react, "React").when(html_doc, "HTML")
        .when(js | ts | html, scripted)
    )
    language = (
        F.when(python, lang).when(vue | react, script_language(code)).when(html_doc, "html")
        .when(js, "javascript").when(ts, "typescript").when(html, script_language(code))
    )
    for prefixes, name, label in compiled:
        environment = environment.when(starts_with_any(lang, prefixes), name)
        language = language.when(starts_with_any(lang, prefixes), label)
    environment = environment.when(lang == "c", "C Runner")
    language = language.when(lang == "", "markdown").otherwise(lang)
    return environment, language


def block_dependencies(lang: Column, code: Column, blocks: Column) -> tuple[Column, Column]:
    """(python, npm) packages of the main block and of the other blocks' installs."""
    python = starts_with_any(lang, PYTHON_PREFIXES)
    scripted = starts_with_any(lang, VUE_PREFIXES + REACT_PREFIXES)
    html_doc = is_html_document(lang, code) & ~python & ~scripted
    any_script = starts_with_any(lang, JS_PREFIXES + TS_PREFIXES + HTML_PREFIXES)
    none = F.array().cast("array<string>")
    main_code = F.when(python, without_inline_pip(code)).otherwise(code)
    others = F.filter(
        F.transform(blocks, lambda b: squeeze(b["code"])), lambda c: c != main_code
    )
    pip, npm = install_packages(F.array_join(others, "\n"))
    own_python = F.when(
        python, F.array_union(python_imports(code), inline_pip_packages(code))
    ).otherwise(none)
    own_npm = (
        F.when(python, none).when(html_doc, script_tag_packages(code))
        .when(scripted | any_script, npm_imports(code)).otherwise(none)
    )
    return F.array_union(own_python, pip), F.array_union(own_npm, npm)


def fallback_environment(code: Column, low: Column, head: Column) -> tuple[Column, Column]:
    """(environment, language) of code without any fence, by ordered substrings.

    ``low`` is the lower-cased code, ``head`` the start of the stripped code, both
    given as columns so that they are computed once per row.
    """
    pythonic = contains_any(code, ["def ", "class ", "import "])
    remarks = contains_any(code, ["//", "/*"])
    rules = [
        (starts_with_any(head, ["<!doctype", "<html", "<!DOCTYPE", "<HTML"]), "HTML", "html"),
        (contains_any(code, ["height: 100vh", "width: 100%", "<style>"]), "HTML", "html"),
        (contains_any(code, ["import React", "import * as React"]) | low.contains("from react"),
         "React", "javascript"),
        (low.contains("import streamlit"), "Streamlit", "python"),
        (low.contains("import pygame"), "PyGame", "python"),
        (contains_any(low, ["import vue", "from vue"]) | code.contains("<template>"),
         "Vue", "javascript"),
        (low.contains("import gradio"), "Gradio", "python"),
        (low.contains("mermaid") & contains_any(low, ["graph", "flowchart"]), "Mermaid", "mermaid"),
        (low.contains("three") | code.contains("OrbitControls"), "React", "javascript"),
        (contains_any(low, ["<svg", "canvas"]), "HTML", "html"),
        (remarks & pythonic, "Python Runner", "unknown"),
        (remarks, "React", "javascript"),
    ]
    environment, language = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, label in rules[1:]:
        environment, language = environment.when(test, name), language.when(test, label)
    return environment.otherwise("Python Runner"), language.otherwise("unknown")


# ------------------------------------------------------------ small extracts

def java_class_name(code: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, JAVA_CLASS, 1), F.lit("")), F.lit("Main"))


def placeholders(code: Column) -> Column:
    """Placeholder URLs as (url, width, height) with clamped sizes.

    A zero side means 100 x 100; a side over 10000 caps both at 1000.
    """
    zipped = F.arrays_zip(
        F.regexp_extract_all(code, F.lit(PLACEHOLDER), 0).alias("url"),
        F.regexp_extract_all(code, F.lit(PLACEHOLDER), 1).alias("w"),
        F.regexp_extract_all(code, F.lit(PLACEHOLDER), 2).alias("h"),
    )

    def clamp(row: Column, name: str) -> Column:
        huge = F.lit(10**6).cast("decimal(38,0)")  # more digits than fit
        w, h = (F.coalesce(row[c].try_cast("decimal(38,0)"), huge) for c in ("w", "h"))
        own = w if name == "w" else h
        wide = (w > 10000) | (h > 10000)
        size = F.when((w <= 0) | (h <= 0), F.lit(100)).when(
            wide, F.least(own, F.lit(1000).cast("decimal(38,0)"))
        ).otherwise(own)
        return size.cast("bigint")

    return F.transform(
        zipped,
        lambda r: F.struct(
            r["url"].alias("url"), clamp(r, "w").alias("width"), clamp(r, "h").alias("height")
        ),
    )


def joined_blocks(answer: Column) -> Column:
    """All code blocks joined by a blank line, else the whole answer."""
    codes = F.regexp_extract_all(answer, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), 1)
    return F.when(F.size(codes) > 0, F.array_join(codes, "\n\n")).otherwise(answer)


def dependency_problem(dependencies: Column) -> Column:
    """First violation of the (type, package, version) rows, '' when all are fine."""

    def check(dep: Column) -> Column:
        kind, package, version = F.get(dep, 0), F.get(dep, 1), F.get(dep, 2)
        python_ok = contains_any(version, ["==", ">=", "<=", "~=", ">", "<"]) | (
            F.lower(version) == "latest"
        )
        npm_ok = version.startswith("@") | (F.lower(version) == "latest")
        versioned = squeeze(version) != ""
        return (
            F.when(F.size(dep) != 3, "Each dependency must have type, package and version fields")
            .when(squeeze(package) == "", F.lit(None))
            .when(~F.lower(kind).isin("python", "npm"), F.concat(F.lit("Invalid dependency type: "), kind))
            .when((F.lower(kind) == "python") & versioned & ~python_ok,
                  F.concat(F.lit("Invalid Python version format for "), package, F.lit(": "), version))
            .when((F.lower(kind) == "npm") & versioned & ~npm_ok,
                  F.concat(F.lit("Invalid NPM version format for "), package, F.lit(": "), version))
        )

    problems = F.array_compact(F.transform(dependencies, check))
    return F.coalesce(F.get(problems, 0), F.lit(""))
