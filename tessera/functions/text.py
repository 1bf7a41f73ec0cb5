"""String and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders with a set module name, folders that name a layer, roots without meaning,
# code extensions and file suffixes.
INFRASTRUCTURE = {
    "utils": "Utilities", "util": "Utilities", "lib": "Utilities", "common": "Shared", "shared": "Shared", "types": "Shared Types",
    "config": "Configuration", "configs": "Configuration", "constants": "Configuration",
}
LAYERS = ["controllers", "services", "repositories", "routes", "handlers", "middleware", "middlewares"]
ROOTS = ["src", "app", "source"]
CODE_EXTENSION = r"\.(ts|tsx|js|jsx|py|go|cpp)$"
LAYER_SUFFIX = r"(?i)\.(controller|service|repository|route|handler|middleware)$"

# Files that a review leaves out.
DENIED = [
    r"package-lock\.json$", r"yarn\.lock$", r"pnpm-lock\.yaml$", r"^dist/", r"^build/", r"^coverage/", r"\.min\.(js|css)$",
    r"(?i:\.(jpg|jpeg|png|gif|svg|webp|ico|mp4|webm|wav|mp3|eot|ttf|woff|woff2)$)",
]


def extension(path: Column) -> Column:
    """'.ts' of 'a/B.TS'; '' without one, and of dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def segments(path: Column) -> Column:
    """The folders of a path, without empty ones and '.'."""
    return F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/", -1), lambda s: (s != "") & (s != "."))


def title(text: Column) -> Column:
    """Dashes and underscores become spaces, and the first ASCII letter of each word a capital; the rest stays."""
    words = F.split(F.regexp_replace(text, "[-_]", " "), r"(?<=\W)|(?=\W)", -1)
    return F.trim(F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), ""))


def module_name(path: Column) -> Column:
    """The module a file belongs to, by its path: a shared folder's fixed name, a layer's feature, or the deepest folder that says something."""
    folders = segments(path)
    lower = F.transform(folders, F.lower)
    fixed = F.create_map(*[F.lit(x) for pair in INFRASTRUCTURE.items() for x in pair])
    shared = F.filter(lower, lambda s: s.isin(*INFRASTRUCTURE))
    feature = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), CODE_EXTENSION, ""), LAYER_SUFFIX, "")
    telling = F.filter(folders, lambda s: ~F.lower(s).isin(*ROOTS))
    return (
        F.when(F.size(shared) > 0, F.element_at(fixed, F.try_element_at(shared, F.lit(1))))
        .when(F.try_element_at(lower, F.lit(-1)).isin(*LAYERS), title(feature))
        .otherwise(title(F.coalesce(F.try_element_at(telling, F.lit(-1)), F.lit("Root"))))
    )


def normalised(path: Column) -> Column:
    """A path without '.', empty and resolvable '..' segments."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/", -1),
            F.array().cast("array<string>"),
            lambda done, s: F.when(s.isin("", "."), done)
            .when((s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(s))),
        ),
        "/",
    )


def denied(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in DENIED))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def uri_component(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and - _ . ! ~ * ' ( ) stay, as in a browser."""
    encoded = F.url_encode(text)
    for written, wanted in {"+": "%20", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}.items():
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def age(then: Column, now: Column) -> Column:
    """'59 seconds ago' ... 'Yesterday' ... '2 days ago'."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    say = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(seconds < 60, say(seconds, "seconds"))
        .when(seconds < 3600, say(F.floor(seconds / 60), "minutes"))
        .when(seconds < 86400, say(F.floor(seconds / 3600), "hours"))
        .when(seconds < 172800, F.lit("Yesterday"))
        .otherwise(say(F.floor(seconds / 86400), "days"))
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Critical", 1).when(severity == "Major", 2).when(severity == "Minor", 3).otherwise(4)


def severity_bucket(severity: Column) -> Column:
    """How a finding is shown: critical, major (warnings too), minor, else info; a missing severity is info."""
    low = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(low == "critical", "critical").when(low.isin("major", "warning"), "major").when(low == "minor", "minor").otherwise("info")


def interview_ready(config: Column) -> Column:
    """Whether an interview's configuration, a struct, names a mode and a difficulty."""
    given = lambda c: F.coalesce(config[c] != "", F.lit(False))
    return given("mode") & given("difficulty")


def with_feedback(question: Column, correction: Column) -> Column:
    """The next question, after the corrective feedback (needed, explanation, keyPoints) where some is needed."""
    points = F.array_join(F.transform(correction["keyPoints"], lambda p: F.concat(F.lit("- "), p)), "\n")
    # The headings of the feedback.
    text = F.concat(F.lit("**Corrective Feedback:**\n"), correction["explanation"], F.lit("\n\n**Key Points:**\n"), points, F.lit("\n\n---\n\n"), question)
    return F.when(correction["needed"], text).otherwise(question)


#: What is embedded of a summary by the kind of node: its fields in order, and what joins those that are lists.
EMBEDDED = {
    "file": [("purpose", None), ("summary", None), ("responsibilities", ". "), ("keywords", ", ")],
    "component": [("purpose", None), ("summary", None), ("responsibilities", ". "), ("keywords", ", ")],
    "architecture": [("summary", None), ("architectureStyle", None), ("majorLayers", ", "), ("requestFlows", ". "), ("crossCuttingConcerns", ", "), ("keywords", ", ")],
    "repository": [("purpose", None), ("summary", None), ("features", ". "), ("keywords", ", ")],
}


def summary_text(kind: Column, payload: Column) -> Column:
    """The text that is embedded of a summary's JSON, by its kind of node; of unknown kinds summary, purpose and the JSON itself. Empty fields go."""
    fields = {name: joint for parts in EMBEDDED.values() for name, joint in parts}
    node = F.from_json(payload, ", ".join(f"{name} {'array<string>' if joint else 'string'}" for name, joint in fields.items()))
    part = lambda name: F.array_join(node[name], fields[name]) if fields[name] else node[name]
    out = joined("\n", node["summary"], node["purpose"], payload)
    for name, parts in EMBEDDED.items():
        out = F.when(F.lower(kind) == name, joined("\n", *[part(p) for p, _ in parts])).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    """Without white space at either end, no-break and other Unicode spaces among it."""
    return F.regexp_replace(text, r"^[\s\u00a0\ufeff\p{Z}]+|[\s\u00a0\ufeff\p{Z}]+$", "")
