"""Scalar helpers on columns: slugs, stems, identifiers, escapes, values and commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each language, and the folders of code from elsewhere.
EXTENSIONS = {
    "cpp": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx"),
    "go": ("go",),
    "java": ("java",),
    "python": ("py", "pyi"),
    "rust": ("rs",),
    "tsx": ("tsx", "jsx"),
    "typescript": ("ts", "mts", "cts", "js", "mjs", "cjs"),
}
VENDORED = ("vendor", "vendored", "node_modules", "third_party", "thirdparty")
LANGUAGES = {e: name for name, found in EXTENSIONS.items() for e in found}


def language(rel: Column) -> Column:
    """The language of a path by its extension (a name that is all extension has none), null where none is known."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, F.regexp_extract(rel, r"[^/]\.([^./]+)$", 1))


def vendored(rel: Column) -> Column:
    """Below a vendored folder, or minified: the name without its extension ends in .min or -min."""
    return F.exists(F.split(rel, "/"), lambda x: x.isin(*VENDORED)) | rel.rlike(r"\.min\.[^./]*$|-min(\.[^./]*)?$")


def slug(title: Column) -> Column:
    """Lower case; letters and digits stay, runs of blanks, - and _ become one -, the rest goes; trimmed."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N} \-_]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \-_]+", "-"), r"^-|-$", "")


def module_stem(rel: Column) -> Column:
    """File stem, or the parent folder's name for mod, __init__ and index."""
    stem = F.regexp_extract(rel, r"([^/]+?)(?:(?<=[^/])\.[^./]*)?$", 1)
    parent = F.regexp_extract(rel, r"([^/]+)/[^/]+$", 1)
    return F.when(stem.isin("mod", "__init__", "index") & (parent != ""), parent).otherwise(stem)


def iri_segment(text: Column) -> Column:
    """Percent-escapes what an IRI's path segment must not hold."""
    for ch in "%/#?<>\"{}|\\^` ":
        text = F.replace(text, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return text


def symbol_iri(base: str, repo: Column, file: Column, scope: Column, name: Column) -> Column:
    chain = F.array_join(F.transform(F.concat(scope, F.array(name)), iri_segment), "::")
    return F.concat(F.lit(base), iri_segment(repo), F.lit("/"), F.replace(file, F.lit("/"), F.lit("%2F")), F.lit("#"), chain)


def turtle_literal(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def repo_identity(url: Column) -> Column:
    """The last segment of a remote's URL, without .git."""
    return F.regexp_replace(F.regexp_extract(F.rtrim(url, F.lit("/")), r"([^/:]+)$", 1), r"\.git$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def first_line(text: Column, most: int = 80) -> Column:
    line = F.element_at(F.split(text, "\n"), 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def provenance(adapter: Column, turn: Column, faction: Column) -> Column:
    """adapter@turnT/faction, parts left out where null."""
    return F.concat(F.coalesce(adapter, F.lit("")), F.coalesce(F.concat(F.lit("@turn"), turn.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("/"), faction), F.lit("")))


def age(now: Column, written: Column) -> Column:
    return F.greatest(now - written, F.lit(0))


def excerpt(evidence: Column) -> Column:
    return F.substring(evidence, 1, 512)


def signed_message(*parts: Column) -> Column:
    """The canonical text that a verdict's signature covers; signing is the caller's."""
    return F.concat_ws("|", F.lit("v1"), *parts)


def introduced(*texts: Column) -> Column:
    """What an edit brings in: its new strings, joined by newlines, nulls left out."""
    return F.concat_ws("\n", *texts)


# Which words of a command name what it does, and the marks of a line that is more than one action.
UNIT_VERBS = ("start", "stop", "restart", "reload", "enable", "disable", "mask", "unmask", "kill", "status")
REMOTE_VERBS = ("clone", "push", "pull", "fetch")
CONTAINER_VERBS = ("start", "stop", "restart", "exec", "destroy", "rm", "kill", "reboot")
COMPOUND = r"[|;`><]|&&|\$\("


def host_of(word: Column) -> Column:
    """The host of `user@host`, `host.domain` or either before `:path`; null for flags, local paths and bare words."""
    side = F.substring_index(word, ":", 1)
    host = F.substring_index(side, "@", -1)
    return F.when(~word.startswith("-") & (host != "") & ~side.contains("/") & (side.contains("@") | host.contains(".")), host)


def command(text: Column) -> Column:
    """struct<verb, target, class> of a shell command whose target is certain from its syntax. All others, compound lines
    among them, are class `unknown` without verb and target."""
    words = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", "")), lambda w: w != "")
    word = lambda at: F.coalesce(F.try_element_at(words, F.lit(at)), F.lit(""))
    program, rest = F.substring_index(word(1), "/", -1), F.slice(words, 2, 1 << 20)
    plain = lambda ws: F.filter(ws, lambda w: ~w.startswith("-"))
    # ssh, scp: the first operand that names a host
    host = F.try_element_at(F.filter(F.transform(rest, host_of), lambda h: h.isNotNull()), F.lit(1))
    # ansible: an explicit limit only, in either spelling
    limits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("next"), i.alias("i"))), lambda x: (x.i > 0) & (x.w.isin("-l", "--limit") | x.w.startswith("--limit=")))
    first = F.try_element_at(limits, F.lit(1))
    limit = F.regexp_replace(F.when(first["w"].startswith("--limit="), F.substring(first["w"], 9, 1 << 20)).otherwise(first["next"]), "^,+|,+$", "")
    verb, operand = F.try_element_at(plain(rest), F.lit(1)), F.try_element_at(plain(rest), F.lit(2))
    unit = F.when(verb.isin(*UNIT_VERBS), F.regexp_replace(operand, r"(?:\.service)+$", ""))
    url = F.try_element_at(plain(F.slice(words, 3, 1 << 20)), F.lit(1))
    name = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"(?:\.git)+$", ""), "[^/:]*$", 0)
    repo = F.when(word(2).isin(*REMOTE_VERBS) & (name != ""), name)
    container = F.when(verb.isin(*CONTAINER_VERBS), operand)
    known = lambda target, verb, kind: F.when(target.isNotNull(), F.struct(verb.alias("verb"), target.alias("target"), F.lit(kind).alias("class")))
    found = (
        F.when(F.coalesce(text, F.lit("")).rlike(COMPOUND), None)
        .when(program.isin("ssh", "scp"), known(host, program, "host"))
        .when(program.isin("ansible", "ansible-playbook"), known(limit, program, "host"))
        .when(program == "systemctl", known(unit, verb, "service"))
        .when(program == "git", known(repo, word(2), "repo"))
        .when(program.isin("pct", "docker", "podman"), known(container, verb, "container"))
    )
    nothing = F.struct(F.lit(None).cast("string").alias("verb"), F.lit(None).cast("string").alias("target"), F.lit("unknown").alias("class"))
    return F.coalesce(found, nothing)
