"""Text, path and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an issue that say nothing about where it belongs.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need must "
    "in on at to for with by from of into about between through after before above below and or but not no nor so yet "
    "this that these those it its i we you he she they me us him her them my our your his their "
    "what which who whom when where why how if then else than just also very too quite rather still already "
    "please help problem wrong broken working work issue bug fix error currently expected actual steps reproduce description "
    "version using see getting seems happens shows showing displayed screenshot following behavior behaviour "
    "feature request functionality pretty nice good want make click button page screen"
).split()

#: Words that keyword search drops.
QUERY_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need must "
    "in on at to for with by from of into about between through after before above below and or but not no nor so yet "
    "this that these those it its i we you he she they me us him her them my our your his their "
    "what which who whom when where why how if then else than just also very too quite rather "
    "file files code function error bug issue fix please help problem wrong broken doesn"
).split()

#: Words of a file name that name no entity.
NOT_ENTITIES = (
    "create delete update get list add remove patch fetch resolver resolvers type types query queries mutation mutations "
    "service services controller controllers test tests spec specs model models schema schemas handler handlers api apis index "
    "field fields input inputs payload payloads validator validators helper helpers util utils config configs route routes"
).split()

#: File extensions that an issue text may name.
PATH_IN_TEXT = r"(?i)[A-Za-z0-9_./\\-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|c|cc|cpp|cxx|h|hpp|hh|hxx|rs)(?![A-Za-z0-9_])"
BACKTICKED = r"`([a-zA-Z_$][a-zA-Z0-9_$]+)`"
CAMEL_WORD = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]*)+|[a-z]+(?:[A-Z][a-z]*)+)(?![A-Za-z0-9_])"
CAMEL_WORD_DIGITS = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:[A-Z][a-z0-9]*)+)(?![A-Za-z0-9_])"


def strings(values: list[str]) -> Column:
    """A literal array."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def camel_spaced(c: Column, digits: bool = False) -> Column:
    """A blank between a small letter (or digit) and a capital."""
    return F.regexp_replace(c, "([a-z0-9])([A-Z])" if digits else "([a-z])([A-Z])", "$1 $2")


def index_tokens(c: Column) -> Column:
    """Tokens of a search entry: the whole text, its parts and their camel parts, lower-cased, each once."""
    parts = F.filter(F.split(c, r"[/\\._\-]+"), lambda x: x != "")
    tokens = F.flatten(
        F.transform(parts, lambda p: F.concat(F.array(F.lower(p)), F.transform(F.filter(F.split(camel_spaced(p), r"\s+"), lambda x: F.length(x) > 1), F.lower)))
    )
    return F.array_distinct(F.concat(F.array(F.lower(c)), tokens))


def query_tokens(c: Column) -> Column:
    """Tokens of a search: quoted phrases, then words; repeats stay."""
    low = F.lower(F.trim(c))
    words = F.filter(F.split(F.regexp_replace(low, '"[^"]+"', ""), r"\s+"), lambda x: x != "")
    return F.concat(F.regexp_extract_all(low, F.lit('"([^"]+)"'), 1), words)


def ranker_tokens(c: Column) -> Column:
    """Terms of a document or query for ranking: split at capitals and marks, longer than one character; repeats stay."""
    # one pass over the text: capitals with what follows them, or what stands alone, of two characters at least
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Z]++[a-z0-9]++|[a-z0-9]{2,}+|[A-Z]{2,}+"), 0), F.lower)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used: what stands inside a lambda is worked out anew for each element, and what is used twice twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _telling(tokens: Column, stopwords: list[str]) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))


def issue_tokens(c: Column) -> Column:
    """Words of an issue over two characters that aren't stopwords; repeats stay."""
    spaced = F.regexp_replace(camel_spaced(c), "[^a-zA-Z0-9']", " ")
    return _telling(F.split(F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " "))), " "), STOPWORDS)


def keyword_tokens(c: Column) -> Column:
    """Words of a search text with their camel and path parts, each once."""
    stop = strings(QUERY_STOPWORDS)
    words = F.filter(F.split(F.regexp_replace(c, r"[^a-zA-Z0-9_\-./\\@#:]", " "), r"\s+"), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, F.lower(x)))
    none = F.array().cast("array<string>")

    def expanded(w: Column) -> Column:
        camel = w.rlike("^[a-z]+[A-Z][a-zA-Z]*$") | w.rlike("^[A-Z][a-z]+[A-Z][a-zA-Z]*$")
        camel_parts = F.when(camel, F.split(camel_spaced(w), " ")).otherwise(none)
        path_parts = F.when(w.contains("/") | w.contains("\\"), F.split(w, r"[/\\.]")).otherwise(none)
        parts = F.filter(F.concat(camel_parts, path_parts), lambda x: F.length(x) > 1)
        return F.concat(F.array(F.lower(w)), F.transform(parts, F.lower))

    return F.array_distinct(F.flatten(F.transform(words, expanded)))


def code_identifiers(c: Column) -> Column:
    """Back-ticked identifiers with their parts, and the parts of camel-cased words, each once."""

    def parts(x: Column) -> Column:
        return _telling(F.split(F.lower(camel_spaced(x)), " "), STOPWORDS)

    ticked = F.transform(F.regexp_extract_all(c, F.lit(BACKTICKED), 1), lambda x: F.concat(parts(x), F.array(F.lower(x))))
    camel = F.transform(F.regexp_extract_all(c, F.lit(CAMEL_WORD), 1), parts)
    return F.array_distinct(F.flatten(F.concat(ticked, camel)))


def explicit_paths(c: Column) -> Column:
    """Paths of source files that a text names, with their base names."""
    full = F.filter(F.transform(F.regexp_extract_all(c, F.lit(PATH_IN_TEXT), 0), lambda x: F.lower(F.replace(x, F.lit("\\"), F.lit("/")))), lambda x: F.length(x) >= 4)
    both = F.transform(full, lambda x: F.array(x, F.element_at(F.split(x, "/"), -1)))
    return F.array_distinct(F.filter(F.flatten(both), lambda x: x != ""))


def strong_identifiers(c: Column) -> Column:
    """Back-ticked and camel-cased identifiers as a whole, lower-cased, each once."""
    ticked = F.regexp_extract_all(c, F.lit(r"`([A-Za-z_$][A-Za-z0-9_$]+)`"), 1)
    camel = F.regexp_extract_all(c, F.lit(CAMEL_WORD_DIGITS), 1)
    return F.array_distinct(F.transform(F.concat(ticked, camel), F.lower))


def search_intent(title: Column, body: Column, comments: Column, split_strong: bool = False) -> Column:
    """struct(entities, exact_paths, strong_identifiers, weak_terms, is_vague) of an issue.

    The title counts twice, comments beyond five are left out. With
    ``split_strong`` identifiers are split before they are lower-cased.
    """
    text = F.concat_ws(" ", title, title, body, F.array_join(F.slice(comments, 1, 5), " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "(?s)```.*?```", " "), "[^a-zA-Z0-9]", " "), r"\s+", " "))

    def read(t: Column) -> Column:
        return F.struct(code_identifiers(t).alias("codes"), issue_tokens(t).alias("tokens"), explicit_paths(t).alias("paths"), strong_identifiers(t).alias("strong"))

    def joined(x: Column) -> Column:
        strong = F.array_distinct(F.concat(x["strong"], x["codes"])) if split_strong else x["strong"]
        parts = F.flatten(F.transform(strong, lambda s: F.split(F.lower(camel_spaced(s)), " ")))
        return F.struct(x["codes"].alias("codes"), x["tokens"].alias("tokens"), x["paths"].alias("paths"), strong.alias("strong"), parts.alias("parts"), F.array_distinct(F.concat(x["codes"], x["tokens"])).alias("entities"))

    def intent(x: Column) -> Column:
        weak = F.filter(x["tokens"], lambda t: ~F.array_contains(x["parts"], t))
        code_signal = (F.size(x["codes"]) > 0) | (F.size(x["strong"]) > 0) | (F.size(x["paths"]) > 0)
        vague = ~code_signal & ((F.size(x["entities"]) < 2) | (F.length(plain) < 80))
        return F.struct(
            F.slice(x["entities"], 1, 20).alias("entities"), x["paths"].alias("exact_paths"), x["strong"].alias("strong_identifiers"),
            F.slice(weak, 1, 20).alias("weak_terms"), vague.alias("is_vague"),
        )

    return bound(text, lambda t: bound(read(t), lambda x: bound(joined(x), intent)))


def token_similarity(q: Column, t: Column) -> Column:
    """How well a query token matches an entry's token, 0 to 1; edit distance is computed last and only up to 2."""
    distance = F.when((F.length(q) <= 15) & (F.length(t) <= 25) & (F.abs(F.length(q) - F.length(t)) <= 2), F.levenshtein(q, t, 2))
    return (
        F.when(q == t, 1.0)
        .when((F.length(q) <= 3) & t.startswith(q), 0.8)
        .when(F.length(q) <= 3, 0.0)
        .when(t.startswith(q), 0.9)
        .when(t.contains(q), 0.7)
        .when(distance == 1, 0.6)
        .when((distance == 2) & (F.length(q) >= 5), 0.4)
        .otherwise(0.0)
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column, root: str = "") -> Column:
    """All but the last segment of a path; ``root`` for paths of one segment."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(root))


def entity_noun(name: Column) -> Column:
    """The first word of a file name that names an entity, capitalised; Core if there is none."""
    stem = F.element_at(F.split(name, r"\."), 1)
    skip = strings(NOT_ENTITIES)
    words = F.filter(F.transform(F.split(stem, "(?=[A-Z])|[^a-zA-Z]"), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~F.array_contains(skip, x))
    first = F.try_element_at(words, F.lit(1))
    return F.coalesce(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 20)), F.lit("Core"))


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading segments that two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at(x, k.cast("int")) != F.element_at(y, k.cast("int")))
    return F.coalesce(F.array_min(differs) - 1, n)


def common_path(a: Column, b: Column) -> Column:
    """The leading segments that two paths share; empty if one of them is empty."""
    prefix = F.array_join(F.slice(F.split(a, "/"), F.lit(1), shared_prefix_length(a, b)), "/")
    return F.when(a == b, a).when((a == "") | (b == ""), "").otherwise(prefix)


def merged_name(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Name of two merged clusters: their common path if it has two segments, else the larger one's name."""
    prefix = common_path(a, b)
    return F.when((prefix != "") & (F.size(F.split(prefix, "/")) >= 2), prefix).when(size_a >= size_b, a).otherwise(b)


def normalised_path(path: Column) -> Column:
    """A path without empty and ``.`` segments, ``..`` taken back."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step), "/")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_count(c: Column) -> Column:
    """Lines of a text; a line end at the end begins one more."""
    return F.size(lines(c))


def line_slice(c: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, both included."""
    first = F.greatest(start, F.lit(1)).cast("int")
    n = F.greatest(F.least(end.cast("int"), line_count(c)) - first + 1, F.lit(0))
    return F.array_join(F.slice(lines(c), first, n), "\n")


def semantic_truncate(c: Column) -> Column:
    """Texts over 80 lines keep the first 60 and the last 20."""
    own = lines(c)
    n = F.size(own)
    marker = F.format_string("// ... [%d lines omitted] ...", n - 80)
    short = F.concat(F.slice(own, 1, 60), F.array(marker), F.slice(own, -20, 20))
    return F.when(n <= 80, c).otherwise(F.array_join(short, "\n"))


#: Fixed value: lines of a file's head that carry no meaning of their own.
BOILERPLATE = (
    r"^\s*$|^\s*(//|#|\*|/\*|\*/)|^\s*(import\s|from\s+\S+\s+import\s|export\s+\*|export\s+\{|const\s+\w+\s*=\s*require\(|#include\b|using\s+\w|package\s+\w|use\s+\w)"
)


def strip_boilerplate(c: Column) -> Column:
    """A text without its leading blank, comment and import lines; the whole text if it has no others."""
    own = lines(c)
    first = F.array_position(F.transform(own, lambda x: ~x.rlike(BOILERPLATE)), True)
    return F.when(first == 0, c).otherwise(F.array_join(F.slice(own, F.greatest(first, F.lit(1)).cast("int"), F.size(own)), "\n"))


def smart_truncate(c: Column, terms: Column, most: int = 300) -> Column:
    """Texts over ``most`` lines keep the numbered lines around a term, or their head and tail if no term occurs."""
    own = lines(c)
    n = F.size(own)
    low = F.transform(own, F.lower)
    hits = F.filter(F.sequence(F.lit(1), n), lambda k: F.exists(terms, lambda t: F.element_at(low, k.cast("int")).contains(F.lower(t))))
    near = F.array_distinct(F.flatten(F.transform(hits, lambda k: F.sequence(F.greatest(k - 10, F.lit(1)), F.least(k + 10, n)))))
    numbered = F.transform(F.array_sort(near), lambda k: F.concat(F.lit("L"), k.cast("string"), F.lit(": "), F.element_at(own, k.cast("int"))))
    relevant = F.concat(F.lit("... [Showing relevant sections] ...\n\n"), F.array_join(numbered, "\n"))
    ends = F.array_join(F.concat(F.slice(own, 1, 150), F.array(F.lit("\n... omitted ...\n")), F.slice(own, F.greatest(n - 49, F.lit(1)), F.lit(50))), "\n")
    return F.when(n <= most, c).when(F.size(hits) > 0, relevant).otherwise(ends)


def dedent(c: Column) -> Column:
    """A text without the indent that all lines but blank ones share."""
    own = lines(c)
    indents = F.transform(F.filter(own, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^\s*", 0)))
    least = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(own, lambda x: F.substr(x, least + 1)), "\n")


def node_radius(line_count: Column) -> Column:
    n = F.when(F.coalesce(line_count, F.lit(0)) == 0, 1).otherwise(line_count)
    return F.greatest(F.lit(6.0), F.least(F.lit(30.0), F.sqrt(n) * 1.5))


def edge_width(symbols: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.size(symbols) * 0.5))


def edge_dash(kind: Column) -> Column:
    return F.when(kind == "dynamic", "6,3").when(kind == "re-export", "2,2").otherwise("none")


def source_link(base: str, owner: Column, repo: Column, commit: Column, path: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A link to a file, or to lines of it, at a source host; each path segment is percent-encoded."""
    quoted = F.array_join(F.transform(F.split(path, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    link = F.concat(F.lit(f"{base}/"), owner, F.lit("/"), repo, F.lit("/blob/"), commit, F.lit("/"), quoted)
    return link if start is None else F.concat(link, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


#: Labels and colours of languages, and badges of function kinds.
LANGUAGE_LABELS = {"typescript": "TypeScript", "javascript": "JavaScript", "tsx": "TSX", "jsx": "JSX", "json": "JSON", "css": "CSS", "html": "HTML",
                   "python": "Python", "go": "Go", "c": "C", "cpp": "C++", "unknown": "Other"}
LANGUAGE_COLOURS = {"typescript": "#3178c6", "javascript": "#e8a400", "tsx": "#7c3aed", "jsx": "#ea580c", "json": "#6b7280", "css": "#ec4899",
                    "html": "#ef4444", "python": "#3776ab", "go": "#00add8", "c": "#a8b9cc", "cpp": "#f34b7d", "unknown": "#6b7280"}
KIND_BADGES = {"function": "fn", "arrow": "=>", "method": "method", "constructor": "ctor", "getter": "get", "setter": "set", "async": "async",
               "component": "<Comp/>", "hook": "hook", "reducer": "reduce", "route-handler": "route", "middleware": "mw", "test": "test",
               "utility": "util", "callback": "cb", "context-provider": "ctx", "structure": "struct", "unknown": "fn"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_label(language: Column) -> Column:
    other = F.when(F.coalesce(language, F.lit("")) == "", "Other").otherwise(F.concat(F.upper(F.substring(language, 1, 1)), F.substring(language, 2, 1 << 20)))
    return F.coalesce(_looked_up(LANGUAGE_LABELS, language), other)


def language_colour(language: Column) -> Column:
    return F.coalesce(_looked_up(LANGUAGE_COLOURS, language), F.lit(LANGUAGE_COLOURS["unknown"]))


def kind_badge(kind: Column) -> Column:
    return F.coalesce(_looked_up(KIND_BADGES, kind), F.lit("fn"))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10.0**places
    return F.floor(x * k + 0.5).cast("double") / k


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def call_cost(prompt: Column, completion: Column, per_million_in: float = 0.075, per_million_out: float = 0.30) -> Column:
    return (prompt * per_million_in + completion * per_million_out) / 1_000_000


def parse_commented_json(c: Column, schema: str) -> Column:
    """Fields of a JSON text with // and /* */ comments; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.from_json(plain, schema)


def device_id(c: Column) -> Column:
    """A device's id without other characters, 64 at most; null if under 8 are left."""
    own = F.substring(F.regexp_replace(c, "[^A-Za-z0-9-]", ""), 1, 64)
    return F.when(F.length(own) >= 8, own)


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def sanitised_key(c: Column) -> Column:
    """A file id as a storage key; different ids can get the same key."""
    return F.regexp_replace(F.regexp_replace(c, r"[/\\]", "-"), r"[^a-zA-Z0-9.\-_]", "_")


def event_frames(c: Column) -> Column:
    """The JSON frames of a server-sent event stream as structs (type, label, text); broken ones are left out."""
    frames = F.filter(F.split(c, "\n\n"), lambda x: x.startswith("data: "))
    parsed = F.transform(frames, lambda x: F.from_json(F.substr(x, F.lit(7)), "type string, label string, text string"))
    return F.filter(parsed, lambda x: x.isNotNull() & x["type"].isNotNull())


def comment_digest(comments: Column) -> Column:
    """The first five comments (author, body) as lines, 300 characters of each."""
    return F.array_join(F.transform(F.slice(comments, 1, 5), lambda x: F.concat(x["author"], F.lit(": "), F.substring(x["body"], 1, 300))), "\n")


def chat_title(first_message: Column) -> Column:
    """Title of a conversation: its first user message on one line, 48 characters at most."""
    flat = F.trim(F.regexp_replace(first_message, r"\s+", " "))
    return F.when(F.length(flat) > 48, F.concat(F.substring(flat, 1, 47), F.lit("…"))).otherwise(flat)
