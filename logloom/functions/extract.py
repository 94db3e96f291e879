"""Rules and how they become columns: regex, key=value and JSON-path extraction, and the event document."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .backtracking import growth
from .fingerprint import SPACES, bound, strip

#: The pattern of rules that read a line as JSON.
JSON_RULE = "__JSON__"
#: What a mapping may target, header groups that are no payload, and pattern caps.
TARGETS = ("src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "time", "severity_id", "action", "message")
STRUCTURAL = ("extension", "vendor", "product", "version", "sig_id", "name", "severity")
MOST_CHARS, MOST_GROUPS, MOST_DEPTH, LINE_CAP = 1000, 32, 5, 65_536
CLASS_UID, CLASS_NAME, ACTIVITY_ID = 4001, "Network Activity", 99
#: Lines longer than this are too long for a pattern whose cost may grow with their square: 16 million steps are about 50 ms.
SQUARE_CAP = 4_096
SQUARE_ERROR = f"line exceeds {SQUARE_CAP} characters for a pattern of quadratic cost"
#: key="value" or key=value up to the next key. A match never starts inside a word, where it could only fail again, and looks
#: for the next key only where blanks begin (or after the blank that a value may consist of): the cost is linear.
PAIR = r'(?U)(?<!\w)(\w++)=(?:"([^"]*+)"|([^=]+?)(?=(?:(?<!\s)|(?<==\s))\s++\w++=|$))'

#: The members of a JSON object as VARIANTs, and texts that may be a list, an object or a number with a sign, a fraction or an exponent.
MEMBERS = "map<string,variant>"
UNSURE = r"^(?:[\[{-]|\d+(?:[eE]|\.\d+(?:[eE]|$)))"

#: The parts of what follows the brace of a JSON object: braces that close; keys with the braces that their values open, one in the
#: other; members side by side that open none; the whole rest, if it is none of these. All repetitions are possessive, so that a search
#: is linear and calls itself no deeper than lists are nested, of which LISTS levels are told.
GAP, STRING, LISTS = r"[ \t\n\r]*+", r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', 4
LIST = "(?!)"
for _ in range(LISTS):
    LIST = rf'\[(?:[^\[\]"]++|{STRING}|{LIST})*+\]'
VALUE = rf'(?:{STRING}|{LIST}|[^ \t\n\r,:{{}}\[\]"]++)'
NAME = rf"{STRING}{GAP}:{GAP}"
INNER = f'"({STRING[1:-1]})"'
PART = rf"\}}(?:{GAP}\}})*+|{NAME}(?:\{{(?:{GAP}{NAME}\{{)*+|{VALUE}(?:{GAP},{GAP}{NAME}{VALUE})*+)|[^ \t\n\r,][\s\S]*+"
#: Texts of more parts than this are opened level by level: what is found is copied with each part.
MOST_PARTS = 256
#: As are longer texts: the reader takes no name of more than so many characters, and names of nested objects are joined.
LONGEST = 50_000
#: What numbers that are too large for a double have: three digits of an exponent or 200 digits side by side.
LARGE = r"\d[eE]\+?\d{3}|(?<!\d)\d{200}"


@dataclass(frozen=True)
class Rule:
    fingerprint_id: str
    version: int
    pattern: str
    mappings: tuple[tuple[str, str], ...]
    provenance: str = "human"
    status: str = "active"
    quarantined: tuple[str, ...] = field(default=())

    def effective(self) -> Rule:
        """Without the mappings of quarantined targets: their values stay among the unmapped."""
        return Rule(self.fingerprint_id, self.version, self.pattern, tuple(m for m in self.mappings if m[1] not in self.quarantined), self.provenance, self.status, self.quarantined)


@dataclass(frozen=True)
class JavaPattern:
    pattern: str
    groups: dict[str, int]
    #: Of groups that may take no part: two more, of which one takes a character beside the group if, and only if, it does.
    witnesses: dict[str, tuple[int, int]] = field(default_factory=dict)

    def value(self, raw: Column, name: str) -> Column:
        """What a named group takes; null if it takes no part."""
        taken = F.regexp_extract(raw, self.pattern, self.groups[name])
        if name not in self.witnesses:
            return taken
        before, after = (F.regexp_extract(raw, self.pattern, k) != "" for k in self.witnesses[name])
        return F.when(before | after, taken)


#: An empty group says nothing of whether it took part. What follows it takes the character before or after: only an empty line has neither.
WITNESS = r"(?:(?<=([\s\S]))|(?=([\s\S]))|)"
PIECE = re.compile(r"(?P<number>\\[1-9]\d?)|(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|\(\?P<(?P<named>\w+)>|\(\?P=(?P<again>\w+)\)|(?P<special>\(\?)|(?P<open>\()|(?P<close>\))|(?P<other>.)", re.S)


def translate(pattern: str) -> JavaPattern:
    """A Python pattern for the JVM: named groups become plain ones with their numbers kept by name.

    In a pattern with alternatives or parts that may be left out, named groups get witnesses, as
    the JVM's functions can't tell a group that takes no part from one that takes nothing.
    """
    pieces = list(PIECE.finditer(pattern))
    optional = any(m["other"] == "|" for m in pieces) or re.search(r"\)(?:[?*]|\{0?,|\{0\})", pattern) is not None
    out, groups, witnesses, numbers, count, stack = [], {}, {}, [0], 0, []
    for m in pieces:
        text = m[0]
        if m["number"]:
            text = f"(?:\\{numbers[int(text[1:])]})"
        elif m["set"]:
            start = 2 if text[1] == "^" else 1
            text = text[:start] + text[start:-1].replace("[", r"\[") + "]" if text[start] != "]" else text[:start] + r"\]" + text[start + 1 : -1].replace("[", r"\[") + "]"
        elif m["again"]:
            text = f"(?:\\{groups[m['again']]})"
        elif m["named"] or m["open"]:
            count += 1
            numbers.append(count)
            stack.append(m["named"])
            if m["named"]:
                groups[m["named"]] = count
                text = "(?:(" if optional else "("
        elif m["special"]:
            stack.append(None)
        elif m["close"] and stack:
            name = stack.pop()
            if name and optional:
                text += WITNESS + ")"
                witnesses[name] = (count + 1, count + 2)
                count += 2
        out.append(text)
    return JavaPattern("(?U)(?d)" + "".join(out), groups, witnesses)


def pattern_errors(pattern: str) -> list[str]:
    """Which caps a pattern breaks: length, groups, depth. Escaped characters never open a group; classes aren't skipped."""
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    depth = deepest = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
    found = ((len(pattern), MOST_CHARS, "length"), (bare.count("("), MOST_GROUPS, "group count"), (deepest, MOST_DEPTH, "nesting depth"))
    return [f"pattern {what} {n} exceeds cap {cap}" for n, cap, what in found if n > cap]


def cost_error(power: float) -> str:
    return "pattern may take exponential time" if power == float("inf") else f"pattern may take time that grows with the power {power} of a line's length"


def too_costly(raw: Column, pattern: str) -> Column:
    """Why a pattern isn't tried on a line, or null: a match that has begun can't be stopped.

    Patterns of unbounded cost, which the gate refuses, read nothing. Patterns of quadratic cost
    read lines of up to SQUARE_CAP characters, as do those whose cost is linear only in lines
    without an inner line feed where a line has one. Patterns that repeat a group read lines
    that the JVM's stack is sure to bear.
    """
    power, single, most = growth(pattern)
    if power > 2:
        return F.lit(cost_error(power))
    found, long = F.when(F.lit(False), F.lit("")), F.length(raw) > SQUARE_CAP
    if most:
        found = found.when(F.length(raw) > most, F.lit(f"line exceeds {most} characters for a pattern that repeats a group"))
    if power > 1:
        found = found.when(long, F.lit(SQUARE_ERROR))
    elif single:
        found = found.when(long & raw.rlike(r"\n[\s\S]"), F.lit(SQUARE_ERROR))
    return found


def rule_errors(rule: Rule) -> list[str]:
    """What forbids a rule whatever the samples: caps, a pattern that doesn't compile, targets outside the list."""
    errors = pattern_errors(rule.pattern)
    if rule.pattern != JSON_RULE:
        try:
            re.compile(rule.pattern)
            if not errors and (power := growth(rule.pattern)[0]) > 2:
                errors.append(cost_error(power))
        except re.error as e:
            errors.append(f"pattern does not compile: {e}")
    return errors + [f"mapping target {t!r} is not allowed" for _, t in rule.mappings if t not in TARGETS]


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of the pairs in a text, in order; values stripped.

    The text is searched once: a key has no =, and only a value in quotes begins and ends with one.
    """
    def parts(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        value = F.substring(pair, F.length(key) + 2, F.length(pair))
        return F.struct(key.alias("key"), bound(value, plain).alias("value"))

    def plain(value: Column) -> Column:
        quoted = value.startswith('"') & value.endswith('"') & (F.length(value) > 1)
        return F.when(quoted, strip(F.substring(value, F.lit(2), F.length(value) - 2), SPACES)).otherwise(strip(value, SPACES))

    return F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), parts)


def last_values(pairs: Column) -> Column:
    """map<string,string> in which the last of equal keys counts."""
    later = lambda all_, p, i: F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"])
    differ = lambda all_: F.size(F.array_distinct(all_["key"])) == F.size(all_)
    return bound(pairs, lambda all_: F.map_from_entries(F.when(differ(all_), all_).otherwise(F.filter(all_, lambda p, i: ~later(all_, p, i)))))


def json_depth(text: Column) -> Column:
    """How deep the braces of a JSON text are nested: those inside strings don't count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"|[^{}"]+', "")
    step = lambda at, c: bound(at["now"] + F.when(c == "{", 1).otherwise(-1), lambda now: F.struct(now.alias("now"), F.greatest(now, at["most"]).alias("most")))
    return F.aggregate(F.regexp_extract_all(bare, F.lit("([{}])")), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda at: at["most"])


def flatten_json(text: Column) -> Column:
    """map<string,string> of a JSON object with nested keys joined by dots, at any depth; null or no object: null.

    Lists and scalars are JSON text as it stands, strings their content, nulls are kept; an empty
    object adds nothing. A text of few parts is made that of one flat object, whatever its depth;
    others are opened level by level.
    """
    known = F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    flat = lambda t: object_of(t, F.expr(f"CAST(map() AS {MEMBERS})"), F.lit(1))
    start = bound(flat_text(text), lambda t: F.when(t.isNotNull(), flat(t)).otherwise(object_of(text, F.try_variant_get(F.try_parse_json(text), "$", MEMBERS), levels(text))))
    return F.when(known, bound(start, lambda s: opened(s["rounds"], s["found"])))


def object_of(text: Column, inside: Column, rounds: Column) -> Column:
    """An object as the one to open, and in how many rounds.

    Which values are objects is known from their VARIANT, so a string with braces in it is a
    string. Each round opens the objects of one level more; the text is read as VARIANT once,
    and each object in it is opened once.
    """
    return F.struct(F.array(F.struct(F.lit("").alias("key"), text.alias("value"), inside.alias("inside"))).alias("found"), rounds.alias("rounds"))


def flat_text(text: Column) -> Column:
    """A text that opens with a valid JSON object as that of one flat object, with the names of nested objects before those in them.

    Null if the text is long or has many parts, deep lists, empty outer names, numbers that no
    double holds or more after the object: those are opened level by level. One search finds the
    parts. Names with braces and closing braces tell what stands before the names of the members
    that follow.
    """
    names = lambda p: F.regexp_extract_all(p, F.lit(INNER), F.lit(1))
    literal = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    below = lambda above, p: F.when(F.size(above) == 0, p).otherwise(F.regexp_replace(p, F.lit(rf"{INNER}({GAP}:{GAP}{VALUE})"), F.concat(F.lit('"'), literal(F.array_join(above, ".")), F.lit('.$1"$2'))))

    def step(at: Column, p: Column) -> Column:
        closes, opens, above, found = p.startswith("}"), p.endswith("{"), at["above"], at["found"]
        # many: braces that are open, the first one too; -1 if there is more after it closes.
        many = F.when(at["many"] <= 0, -1).when(closes, at["many"] - F.length(F.translate(p, " \t\n\r", ""))).otherwise(at["many"])
        upward = bound(many, lambda m: F.struct(F.slice(above, F.lit(1), F.greatest(m - 1, F.lit(0))).alias("above"), m.alias("many"), found.alias("found")))
        downward = bound(F.concat(above, names(p)), lambda now: F.struct(now.alias("above"), F.when(many < 0, many).otherwise(F.size(now) + 1).alias("many"), found.alias("found")))
        return F.when(closes, upward).when(opens, downward).otherwise(F.struct(above.alias("above"), many.alias("many"), F.concat(found, F.array(below(above, p))).alias("found")))

    # A name begins with a dot where an outer one is empty: level by level there is no dot after it.
    end = lambda at: F.when((at["many"] == 0) & ~F.exists(at["found"], lambda f: f.startswith('".')), F.concat(F.lit("{"), F.array_join(at["found"], ","), F.lit("}")))
    start = F.struct(F.array().cast("array<string>").alias("above"), F.lit(1).alias("many"), F.array().cast("array<string>").alias("found"))
    whole = lambda parts: (F.size(parts) <= MOST_PARTS) & F.coalesce(F.try_element_at(parts, F.lit(-1)).startswith("}"), F.lit(False))
    parts = bound(F.trim(text), lambda t: F.when((F.length(t) <= LONGEST) & t.endswith("}") & ~t.rlike(LARGE), F.regexp_extract_all(F.substring(t, F.lit(2), F.length(t)), F.lit(f"({PART})"), F.lit(1))))
    return bound(parts, lambda parts: F.when(whole(parts), F.aggregate(parts, start, step, end)))


def members_of(members: Column, inside: Column, prefix: Column) -> Column:
    """The members of an object, as texts and as VARIANTs, with those of members that are objects themselves."""
    # Only a text that opens with a brace can be an object.
    object_in = lambda e: F.when(F.coalesce(e["value"].startswith("{"), F.lit(False)), F.try_variant_get(F.element_at(inside, e["key"]), "$", MEMBERS))
    entry = lambda e: F.struct(F.concat(prefix, e["key"]).alias("key"), e["value"].alias("value"), object_in(e).alias("inside"))
    return F.coalesce(F.transform(F.map_entries(members), entry), F.array().cast(f"array<struct<key:string,value:string,inside:{MEMBERS}>>"))


def levels(text: Column) -> Column:
    """How deep a JSON text is at most: the number of braces, which is counted faster, or its depth."""
    count = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    return F.when(count > 4, json_depth(text)).otherwise(count)


def opened(rounds: Column, found: Column) -> Column:
    """The map of what is found after so many rounds, each of which opens all objects found so far."""
    members = lambda e: members_of(F.from_json(e["value"], "map<string,string>"), e["inside"], F.when(e["key"] == "", "").otherwise(F.concat(e["key"], F.lit("."))))
    more = lambda found: F.flatten(F.transform(found, lambda e: F.when(e["inside"].isNotNull(), members(e)).otherwise(F.array(e))))
    found = F.aggregate(F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")), found, lambda at, _: more(at))
    return last_values(F.transform(found, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def pairs_of(columns: list[str], pairs: Column, rows: DataFrame) -> DataFrame:
    """rows' columns with a row (key, value) for each entry of a map. A plain explode would add filters that work the map out twice more."""
    return rows.select(*columns, F.explode_outer(pairs).alias("key", "value")).where(F.col("key").isNotNull())


def document(values: dict[str, Column], unmapped: Column, product: str = "logloom") -> Column:
    """The event document of mapped values by target; a port that is no integer is kept as port_raw. Each value is evaluated once."""
    null = F.lit(None).cast("string")

    def build(v: Column) -> Column:
        def endpoint(side: str) -> Column:
            ip, port = v[f"{side}.ip"], v[f"{side}.port"]
            number = port.try_cast("bigint")
            raw = F.when(number.isNull() & ~port.rlike(r"^[\[{]"), port)
            return F.when(ip.isNotNull() | port.isNotNull(), F.struct(ip.alias("ip"), number.alias("port"), raw.alias("port_raw")))

        return F.struct(
            F.lit(CLASS_UID).alias("class_uid"), F.lit(CLASS_NAME).alias("class_name"), F.lit(ACTIVITY_ID).alias("activity_id"), v["severity_id"].try_cast("bigint").alias("severity_id"), v["time"].alias("time"),
            endpoint("src_endpoint").alias("src_endpoint"), endpoint("dst_endpoint").alias("dst_endpoint"), v["action"].alias("action"), v["message"].alias("message"), F.struct(F.lit(product).alias("product")).alias("metadata"), v["unmapped"].alias("unmapped"),
        )

    return bound(F.struct(*[values.get(t, null).alias(t) for t in TARGETS], unmapped.alias("unmapped")), build)


def plain_number(value: Column) -> Column:
    """Digits as the number that they are: without leading zeros."""
    return F.when(value.startswith("0") & value.rlike(r"^0\d+$"), F.regexp_replace(value, r"^0+(?=\d)", "")).otherwise(value)


def regex_document(raw: Column, rule: Rule) -> Column:
    """The document of a line that a regex rule matches: named groups, then pairs of the group extension, which win."""
    java = translate(rule.pattern)
    group = {name: java.value(raw, name) for name in java.groups}
    pairs = key_values(F.coalesce(group["extension"], F.lit(""))) if "extension" in group else F.array().cast("array<struct<key:string,value:string>>")
    targets = dict(rule.mappings)  # of several mappings of a field the last counts
    extra = [F.struct(F.lit(n).alias("key"), group[n].alias("value")) for n in group if n not in STRUCTURAL and n not in targets]
    known = [*STRUCTURAL, *targets]

    def build(found: Column) -> Column:
        def source(s: str) -> Column:
            return F.coalesce(found[s], group[s]) if s in group else found[s]

        values: dict[str, Column] = {}
        for s, t in targets.items():
            values[t] = F.coalesce(source(s), values[t]) if t in values else source(s)
        rest = F.map_filter(found, lambda k, v: ~k.isin(known))
        if extra:
            rest = last_values(F.concat(F.filter(F.array(*extra), lambda p: p["value"].isNotNull()), F.map_entries(rest)))
        return document(values, F.transform_values(rest, lambda k, v: plain_number(v)))

    return bound(last_values(pairs), build)


def json_path(raw: Column, dotted: str) -> Column:
    """The value at a dotted path through nested objects, as text; null if there is none."""
    return F.get_json_object(raw, "$" + "".join(f"['{p}']" for p in dotted.split(".")))


def json_document(raw: Column, rule: Rule) -> Column:
    """The document of a line that is a JSON object: dotted paths through nested objects.

    The line is read once for the members of the object and once for those of the objects in it
    that the paths name, not once a path.
    """
    paths = [s.split(".") for s, _ in rule.mappings]
    outer = list(dict.fromkeys(p[0] for p in paths if len(p) == 2))
    # Lists, objects and numbers that are not written as get_json_object gives them are asked of it.
    sure = lambda v, s: F.when(v.rlike(UNSURE), json_path(raw, s)).otherwise(v)

    def build(found: Column) -> Column:
        def path(s: str) -> Column:
            at = s.split(".")
            if len(at) == 1:
                return sure(found["top"][s], s)
            if len(at) > 2:
                return json_path(raw, s)
            return F.when(found["top"][at[0]].startswith("{"), sure(found["inner"][at[0]][at[1]], s)).otherwise(json_path(raw, s))

        values: dict[str, Column] = {}
        for s, t in rule.mappings:
            values[t] = F.coalesce(path(s), values[t]) if t in values else path(s)
        mapped = [s for s, _ in rule.mappings]
        unmapped = F.map_filter(opened(levels(raw) - 1, members_of(found["top"], found["inside"], F.lit(""))), lambda k, v: ~(k.isin(mapped) & v.isNotNull()))
        return document(values, unmapped)

    nested = T.StructType([T.StructField(k, T.MapType(T.StringType(), T.StringType())) for k in outer])
    inner = [F.from_json(raw, nested).alias("inner")] if outer else []
    parts = F.struct(F.from_json(raw, "map<string,string>").alias("top"), F.try_variant_get(F.try_parse_json(raw), "$", MEMBERS).alias("inside"), *inner)
    return bound(parts, build)


def matches(raw: Column, rule: Rule) -> Column:
    """Whether a rule's pattern matches a line and isn't too costly for it; for a JSON rule, whether the line is an object."""
    if rule.pattern != JSON_RULE:
        found = raw.rlike(translate(rule.pattern).pattern)
        return F.coalesce(found if growth(rule.pattern) == (1, False, None) else F.when(too_costly(raw, rule.pattern).isNull(), found), F.lit(False))
    text = F.trim(raw)
    return F.coalesce(text.startswith("{") & text.endswith("}") & F.try_parse_json(raw).isNotNull(), F.lit(False))


def parse_error(raw: Column, rule: Rule) -> Column:
    """Why a rule can't read a line, or null."""
    wrong = "invalid JSON: expected an object" if rule.pattern == JSON_RULE else "rule pattern did not match line"
    found = F.when(F.length(raw) > LINE_CAP, F.lit(f"line exceeds {LINE_CAP} characters"))
    if rule.pattern != JSON_RULE and growth(rule.pattern) != (1, False, None):
        cost = too_costly(raw, rule.pattern)
        found = found.when(cost.isNotNull(), cost)
    return found.when(~matches(raw, rule), F.lit(wrong))


def parsed_document(raw: Column, rule: Rule) -> Column:
    """The document of a line that the rule can read."""
    rule = rule.effective()
    return json_document(raw, rule) if rule.pattern == JSON_RULE else regex_document(raw, rule)


def parse(raw: Column, rule: Rule) -> Column:
    """struct<doc, error> of one rule on a line: exactly one of them is null."""
    error = parse_error(raw, rule)
    return F.struct(F.when(error.isNull(), parsed_document(raw, rule)).alias("doc"), error.alias("error"))


def load_rules(text: str) -> list[Rule]:
    """Seed rules from JSON text: one object or a list; duplicates and unusable rules are fatal, all or nothing."""
    found: Any = json.loads(text)
    rules = [Rule(x["fingerprint_id"], int(x.get("version", 1)), x["pattern"], tuple((m["source_field"], m["ocsf_path"]) for m in x["mappings"]), x.get("provenance", "human")) for x in (found if isinstance(found, list) else [found])]
    if len({(r.fingerprint_id, r.version) for r in rules}) < len(rules):
        raise ValueError("seed rules name a fingerprint and version twice")
    if wrong := [f"{r.fingerprint_id}: {e}" for r in rules for e in rule_errors(r)]:
        raise ValueError("; ".join(wrong))
    return rules


#: The rules that come with the engine.
SEEDS = (
    *(Rule(f"cef_{v}", 1, r"^.*\|(?P<extension>.*)$", (("src", "src_endpoint.ip"), ("spt", "src_endpoint.port"), ("dst", "dst_endpoint.ip"), ("dpt", "dst_endpoint.port"), ("act", "action"), ("msg", "message"))) for v in ("paloalto", "ciscoasa", "fortigate")),
    Rule("json", 1, JSON_RULE, (("src_ip", "src_endpoint.ip"), ("src_port", "src_endpoint.port"), ("dest_ip", "dst_endpoint.ip"), ("dest_port", "dst_endpoint.port"), ("timestamp", "time"), ("alert.severity", "severity_id"), ("event_type", "action"), ("alert.signature", "message"))),
    Rule("syslog", 1, r"^.*?IPTABLES-\w+:\s*(?P<extension>.*)$", (("SRC", "src_endpoint.ip"), ("SPT", "src_endpoint.port"), ("DST", "dst_endpoint.ip"), ("DPT", "dst_endpoint.port"))),
)
