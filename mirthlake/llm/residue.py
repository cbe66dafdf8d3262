"""Template residue, filler and error pages in text fields.

Three kinds of evidence are combined for a field's value:

- detectors for unfilled placeholders in many notations, stubs, filler, instructions to text generators and their
  replies, frames without content, and messages of servers, programs and browsers; what stands in double quotes is
  quoted and doesn't count;
- corpus evidence for what fixed patterns can't know: words that keep the company of filler text are filler, names
  seen in unmistakable placeholders are names of slots in any brackets;
- responses: a value that stands in several records of several hosts (equal but for numbers and codes), shares no term
  with most of the records' titles and address slugs, and holds little of the field's own words (at least two in five
  hardly occur in other values; copies count once, so a response may fill any share of the rows) is a message nobody
  wrote as content, whatever its language. Values that say such a response somewhere within their text, unquoted, are
  found by its first three words and then by all of them.

Every found value comes with all kinds of evidence that speak against it. Counts of words are kept in 2^18 cells, a
fixed size whatever the vocabulary.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .text import WORD, fold

CELLS = 1 << 18
CODE = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b")
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]")
TAG = re.compile(r"</?(?:p|b|i|u|em|strong|span|div|br|hr|h[1-6]|li|ul|ol|small|code|pre|a|font|td|tr|noscript|center|body|html|title)\b[^<>]*>", re.I)

NAME = r"[^\W\d_][\w.-]*"
#: Notations that nothing but a placeholder has.
SURE = [re.compile(x) for x in (
    r"\{\{\{?[^{}]*\}?\}\}", r"\{%-?[^{}%]*-?%\}", r"<%[=-]?[^<>%]*%>", r"[$#]\{[^{}]*\}", r"\$\(\w+\)", r"%\(\w+\)[sdrf]", r"\[\[[^\[\]]*\]\]", r"@@[\w.-]+@@", r"__[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*__", r"\{\$?\w*(?:[.:!][\w.]*)?\}", r"<<\s*\w+\s*>>", r"\$\$\w+\$\$", r"##\w+##", r"\|\|\w+\|\||\*\|[\w:]+\|\*",
    r"(?<![\w%])%[A-Za-z_]\w*%(?!\w)", r"(?<![\w%])%(?:\d+\$)?[sd](?![\w%])", r"(?<!_)_{3,}(?!_)", r"«\s*\w+\s*»", r"‹\s*\w+\s*›",
    r"(?i)[\[(<{]\s*(?:your|insert|enter|add|put|fill in|type|placeholder|name of|choose|replace|dein|deine|ihr|ihre|tu|su|votre|ton)\b[^\[\](){}<>]{0,40}[\])>}]", r"(?i)[\[(<]\s*[\w ]{1,30}\bhere\s*[\])>]",
    r"<[A-Z][A-Z0-9_]*>", r"\[[A-Z][A-Z0-9]*(?:[_ -][A-Z0-9]+)*\]", r"<[a-z]+(?:_[a-z0-9]+)+>", r"\[[a-z]+(?:_[a-z0-9]+)+\]", r"(?<![\w:]):[a-z]+(?:_[a-z0-9]+)+:?(?!\w)", r"(?<![\w$])\$[A-Za-z_]{2,}\w*",
)]
#: Brackets that hold a slot's name only if corpus or notation says so.
MAYBE = re.compile(r"[<\[({]\s*([^\W\d]\w*)\s*[>\])}]")

REASON = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|request timeout|gone|payload too large|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out|connection refused|server error)"
SCRIPTS = r"(?:java-?script|scripting|scripts?|cookies?|js)"
#: Messages of servers, programs and browsers, wherever they stand in folded text.
MESSAGES = [re.compile(x) for x in (
    rf"\b[45]\d\d\b\W{{0,3}}{REASON}\b", rf"\b{REASON} \(?(?:ref|code|error|id)\b", rf"\b(?:upstream|server|proxy|gateway) (?:said|returned|answered|responded)\b.{{0,12}}{REASON}", r"\bhttp/\d(?:\.\d)? \d{3}\b", rf"\berror:? \d{{3}}\W{{1,3}}{REASON}", rf"^\W*{REASON}\W*$", r"[\"']?(?:status|code|error)[\"']?\s*:\s*[\"']?[45]\d\d\b", rf"[\"']error[\"']\s*:\s*[\"']{REASON}",
    r"\brequest blocked\b", r"\brate limit (?:exceeded|reached)\b", r"\bconnection (?:timed out|reset|refused|closed)\b(?=.{0,30}(?:\d|by peer|$))", r"\bmodel_?(?:overloaded|not_?found|error)\b", r"\brequest [0-9a-f]{6,} was not completed\b", r"\btraceback \(most recent call last\)", r"\b(?:type|key|value|name|attribute|index|runtime|syntax|reference|zerodivision|import|os|io|json\w*)(?:error|exception)\b\s*:", r"\bnull ?pointer ?exception\b", r"\bcannot read propert", r"\bis not defined\b\W*$", r"\bsegmentation fault\b", r"\bstack ?trace\b\W*:", r"\bexception in thread\b",
    r"\boops\W+something went wrong", r"^\W*something went wrong\b", r"\bthe page (?:you (?:requested|were looking for|are looking for)|requested) (?:could not be|cannot be|was not) found", r"^\W*page not found\b", r"^\W*(?:the )?page (?:can(?:not|'t) be displayed|does ?n[o']t exist)", r"\bsession (?:has )?(?:expired|timed out)\b.{0,40}(?:sign|log) ?-?in", r"\bscheduled maintenance\b.{0,30}\b(?:back|soon|try|later)\b", r"^\W*(?:we are|we're|this site is|site is)? ?(?:currently )?(?:down for|under|undergoing) (?:scheduled )?maintenance\b", r"^\W*(?:access|permission) denied\b", r"^\W*acces refuse\b", r"\bseite (?:wurde )?nicht gefunden\b", r"\bpagina no encontrada\b", r"\bpage (?:introuvable|non trouvee)\b", r"\bzugriff (?:verweigert|nicht erlaubt)\b.{0,20}(?:\d|$)", r"\bacceso (?:denegado|prohibido)\b", r"\b(?:erreur|fehler|error) (?:interne|interner|interno)? ?(?:du|des|del)? ?(?:serveur|server|servidor)?s? ?\(?\d{3}\b", r"\binterner serverfehler\b", r"\berror interno del servidor\b", r"\berreur interne du serveur\b", r"\bservice (?:indisponible|nicht verfugbar)\b", r"\bservicio no disponible\b",
    r"\b(?:acces refuse|acceso denegado|zugriff verweigert|access denied|permission denied|page not found|something went wrong)\b(?=\W{0,3}(?:$|code\b|error\b|erreur\b|fehler\b|ref\b|\(?\d{3}))",
    rf"\b(?:enable|activate|allow|turn on|switch on|activer|activez|active|activa|activar|habilite|habilitar|aktivieren|einschalten|erlauben) (?:sie |el |le |les )?{SCRIPTS}\b", rf"\b{SCRIPTS} (?:is|are|ist|est|esta|must be|needs? to be|has been)? ?(?:required|blocked|disabled|deactivated|turned off|off|erforderlich|deaktiviert|desactive|desactivado|requis|necesario)\b", rf"\b(?:works?|runs?) (?:only|best)? ?with {SCRIPTS}\b", rf"\b(?:requires?|needs?) (?:{SCRIPTS})(?: and {SCRIPTS})?\b(?=.{{0,40}}$)", rf"\bturn on {SCRIPTS}", r"\b(?:your )?browser is (?:not supported|out of date|outdated|unsupported)\b", r"\bchecking your browser\b", rf"\ben?able .{{0,20}}{SCRIPTS}\b.{{0,30}}(?:page|site|app|content|continue|view)", r"\bverify(?:ing)? (?:that )?you are (?:a )?human\b", r"\bcaptcha\b", r"<noscript\b", r"\bplease enable cookies\b", r"\bthis site uses cookies\b",
)]
#: What leads in a mention of a message, not the message itself.
SPOKEN = re.compile(r"\b(?:how to|asks?|asked|asking|why|whether|explains?|explained|about|mentions?|mentioned|shows?|talks? of|jokes? about|quotes?)(?: (?:the|a|an))?\W*$")
#: Values that are nothing but a stub, in folded text without outer punctuation.
STUB = re.compile(
    r"(?:n ?[./]? ?a|none|null|nil|nan|undefined|unknown|empty|leer|vacio|vide|missing|blank|tba|tbc|tbd|todo|fixme|xxx+|wip|to be (?:determined|decided|announced|confirmed|defined|added|done|written|filled(?: in)?)(?: .{0,30})?|(?:content )?coming soon|placeholder(?: text| copy)?|platzhalter(?:text)?|text folgt|kommt noch|texto de (?:ejemplo|relleno|muestra)|por definir|pendiente|texte (?:d'exemple|factice|de remplacement)|exemple de texte|a (?:completer|definir)|beispieltext|blindtext|sample (?:text|copy)|example text|dummy (?:text|copy)?|default(?: text| value)?|your (?:text|message|copy|content) (?:goes )?here|insert (?:copy|text|content|message)(?: here)?|add (?:\w+ ){1,3}(?:text|here)|enter (?:\w+ ){1,3}here|(?:\w+ ){1,3}(?:goes|go|comes) here|(?:todo|fixme|tbc|tbd|tba)\b.*|object object|same as above|see above|no (?:data|content|text|description|message)(?: available| provided| yet)?|test(?: text| message)?|asdf+|qwerty?|foo|bar|baz|foobar|bla+h?|deleted|removed)"
)
#: Instructions to a text generator, and its replies.
GENERATOR = [re.compile(x) for x in (
    r"\bas requested\b.{0,20}\bwrite\b", r"\bwrite (?:one|a|two|three|an?) (?:short |single |complete )?(?:sentence|paragraph|message|caption|example)s?\b.{0,40}\b(?:words|characters|tokens|about|that|for|of at)\b", r"\bat (?:least|most) (?:\w+) (?:words|characters|sentences|tokens)\b", r"\bhere (?:is|are|'s) (?:the|your|an?) (?:json|requested|sentence|example|output|response|list|rewritten|revised|text|description|caption|message|metadata)", r"\bas an? (?:ai|artificial|language|large language)\b", r"\bi (?:cannot|can't|can not|am unable to|'m unable to|am sorry, but|'m sorry, but) (?:help|assist|fulfil|comply|generate|provide|create|i)", r"^\W*(?:sure|certainly|of course|absolutely|okay)\b\W+(?:here|i|this|below)\b", r"\b(?:return|respond|reply|answer|output) (?:only |strictly |just )?(?:with |in |as )?(?:valid |the |a )?(?:json|yaml|xml|markdown)\b", r"\bdo not (?:include|add|use|mention|repeat|output|write) (?:any |the )?(?:explanation|quotes|markdown|preamble|commentary|other|name|tags|instructions)", r"^\W*(?:system|user|assistant|human|instruction|prompt|response|output)\s*:\s", r"^\W*###\s*(?:instruction|response|input)", r"<\|[a-z_]+\|>", r"\[/?inst\]", r"^\W*```", r"\{\s*[\"']\w+[\"']\s*:\s*(?:[\"'][^\"']*[\"']|\[|null)", r"^\W*1\. ?\w+:\s*2\. ?\w+:", r"\byou are a (?:helpful|careful|creative|skilled) ", r"\b(?:let me know|feel free to) (?:if|to) (?:you|ask|adjust|change)\b", r"\bi hope this helps\b", r"\bfill in (?:the|each|every) (?:fields?|blanks?|template)", r"\b(?:max(?:imum)?|limit) ?:? ?\d+ (?:words|characters|tokens)\b",
)]
#: A frame whose slots are empty: a joining word right before the end or a punctuation mark.
FRAME = re.compile(r"\b(?:when|if|while|because|after|before|until|unless|where|who|that|which|and|or|of|for|with|by|from|to|the|a|an|in|on|at|about|near|beside|over|once|since|as|like|says|answers|wenn|weil|und|der|die|das|cuando|porque|quand|et|le|la)\s*[,.;:!?]*$|\b(?:when|if|where|while|because|until|that|who|the|a|an|of)\s+[,.;:]|\b(?:when|if)\s+(?:and|or|meets)\b")
#: A longer sentence has content, even where a word is missing.
FRAME_WORDS = 8
LATIN = re.compile(r"\blorem\b")


def plain(value: str) -> str:
    """Folded text with entities resolved, white space single and quoted passages gone."""
    return " ".join(QUOTED.sub(" ", fold(TAG.sub(" ", html.unescape(value)))).split())


def skeleton(value: str) -> str:
    """Folded text without what changes between two issues of one message: numbers and codes."""
    return " ".join(CODE.sub("0", fold(TAG.sub(" ", html.unescape(value)))).split())


def said(text: str) -> str:
    """The words of a skeleton, or of folded text, alone; the text itself if it has none."""
    return " ".join(WORD.findall(CODE.sub("0", text))) or text


def gram(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def cell_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & (CELLS - 1)


def slots(value: str) -> list[str]:
    """Names in notations that nothing but a placeholder has."""
    return [w for p in SURE[:7] for m in p.findall(html.unescape(value)) for w in re.findall(NAME, m.lower()) if w not in ("item", "if", "default", "insert", "your", "s")]


def repeated(words: list[str]) -> bool:
    """One or two words over and over."""
    return len(words) >= 3 and len(set(words)) == 1 or len(words) >= 6 and len(set(words)) == 2


def mashed(words: list[str], known) -> bool:
    """Keys struck at random: no word known to the corpus, and letters no language puts together."""
    if not words or any(known(w) for w in words) or sum(map(len, words)) < 5:
        return False
    bad = sum(len(re.findall(r"[bcdfghjklmnpqrstvwxz]{4,}|[qwx][^aeiouhy\W]|[hjk][fgjkhs]|(.)\1\1", w)) for w in words)
    vowels = sum(c in "aeiouy" for w in words for c in w)
    return bad > 0 or vowels < 0.2 * sum(map(len, words))


def spoken_of(before: str) -> bool:
    """Whether the words before a message only lead in a mention of it; no lead-in has more than four."""
    return bool(SPOKEN.search(" ".join(["", *before.rsplit(None, 4)[-4:]]) + " "))


def residue(value: str, filler, slot, known) -> str | None:
    """The kind of residue in a value, or None. filler, slot, known: what the corpus says of a word."""
    text = html.unescape(value)
    outside = QUOTED.sub(" ", text)
    body = TAG.sub(" ", outside)
    if any(p.search(body) for p in SURE):
        return "placeholder"
    if any(slot(m.lower()) for m in MAYBE.findall(body)):
        return "placeholder"
    bare = plain(value)
    raw = " ".join(fold(text).split())
    if "<noscript" in raw or '"status":' in raw or any(not spoken_of(bare[: m.start()]) for p in MESSAGES for m in p.finditer(bare)):
        return "message"
    core = re.sub(r"^[\W_]+|[\W_]+$", "", " ".join(fold(TAG.sub(" ", text)).split()))
    if not core:
        return "stub"
    if STUB.fullmatch(core) or STUB.fullmatch(re.sub(r"[\W_]+", " ", core)):
        return "stub"
    if any(p.search(raw) for p in GENERATOR):
        return "generator"
    words = WORD.findall(bare)
    if LATIN.search(raw) and sum(filler(w) or w in ("lorem", "ipsum") for w in words) * 2 >= len(words) or len(words) >= 2 and sum(map(filler, words)) * 10 >= 8 * len(words):
        return "filler"
    if repeated(WORD.findall(core)) or mashed(WORD.findall(core), known):
        return "filler"
    if len(words) <= FRAME_WORDS and FRAME.search(bare):
        return "frame"
    return None


def template_residue(values: DataFrame) -> DataFrame:
    """(id, field_name, kind, evidence) of the values that hold template residue, filler or messages.

    values: id, field_name, value, title, address STRING; one row a record and field. evidence: all kinds that speak
    against the value, in order; kind: the first. Null values and ids are no case; null titles and addresses say
    nothing. Repeated rows give one row. Empty input gives an empty result. Values of any length are read whole.
    """
    spark = values.sparkSession
    values = values.where("value is not null and id is not null").select("id", "field_name", "value", "title", "address").distinct()
    cell_type = pa.list_(pa.struct([("cell", pa.int32()), ("latin", pa.bool_()), ("slot", pa.bool_())]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bones, words, host, match, free = [], [], [], [], []
            for v, t, a in zip(b.column("value").to_pylist(), b.column("title").to_pylist(), b.column("address").to_pylist()):
                bones.append(said(skeleton(v)))
                bare = plain(v)
                free.append(said(bare))
                w = set(WORD.findall(bare))
                latin = bool(LATIN.search(bones[-1]))
                words.append([(cell_of(x), latin, False) for x in w] + [(cell_of(x), latin, True) for x in slots(v)])
                head, _, slug = (a or "").partition("://")[2].partition("/")
                host.append(head)
                own = {x for x in WORD.findall(fold((t or "") + " " + slug)) if len(x) > 3}
                match.append(bool(own & w))
            cells = pa.array([[{"cell": c, "latin": l, "slot": s} for c, l, s in w] for w in words], cell_type)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "field_name", "value")], pa.array(bones, pa.string()), pa.array(free, pa.string()), cells, pa.array(host, pa.string()), pa.array(match, pa.bool_())], names=["id", "field_name", "value", "bones", "free", "cells", "host", "match"])

    f = values.mapInArrow(features, "id string, field_name string, value string, bones string, free string, cells array<struct<cell int, latin boolean, slot boolean>>, host string, match boolean").persist(StorageLevel.DISK_ONLY)
    table = np.zeros((3, CELLS), np.int64)
    counted = f.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.count_if(~F.col("c.slot")).alias("n"), F.count_if(F.col("c.latin") & ~F.col("c.slot")).alias("latin"), F.count_if("c.slot").alias("slot"))
    counted = counted.toArrow()  # CELLS rows at most
    table[:, counted.column("cell").to_numpy()] = [counted.column(c).to_numpy() for c in ("n", "latin", "slot")]
    total = f.count()
    # copies of a response must not make its own words usual: here each skeleton counts once
    groups = f.groupBy("bones").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min("host").alias("h"), F.max("host").alias("i"), F.avg(F.col("match").cast("int")).alias("match")).persist(StorageLevel.DISK_ONLY)

    def once_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for b in batches:
            for bones in b.column("bones").to_pylist():
                seen[list({cell_of(w) for w in WORD.findall(bones)})] += 1
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen[cells])], names=["cell", "n"])

    spread = np.zeros(CELLS, np.int64)
    counted = groups.select("bones").mapInArrow(once_each, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    spread[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((table, total, spread, groups.count()))

    def evidence():
        table, total, _, _ = shared.value
        usual = max(5, 0.001 * total)

        def filler(w: str) -> bool:
            n, latin, _ = table[:, cell_of(w)]
            return latin >= 2 and latin * 10 >= n

        return filler, lambda w: table[2, cell_of(w)] >= 2, lambda w: table[0, cell_of(w)] >= usual

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        how = evidence()
        for b in batches:
            kinds = []
            for v in b.column("value").to_pylist():
                if v not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[v] = residue(v, *how)
                kinds.append(known[v])
            kinds = pa.array(kinds, pa.string())
            mask = kinds.is_valid()
            yield pa.RecordBatch.from_arrays([b.column("id").filter(mask), b.column("field_name").filter(mask), kinds.filter(mask)], names=["id", "field_name", "kind"])

    found = f.select("id", "field_name", "value").mapInArrow(judge, "id string, field_name string, kind string")
    # responses: judged once for all values that say the same; two records and two hosts at least
    groups = groups.where("a < z and h < i and match < 0.5")

    def unusual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, spread, skeletons = shared.value
        usual = max(5, 0.001 * skeletons)
        for b in batches:
            keep, first = [], []
            for bones in b.column("bones").to_pylist():
                words = [w for w in WORD.findall(bones) if not w.isdigit()]
                keep.append(len(words) >= 3 and sum(spread[cell_of(w)] < usual for w in words) * 5 >= 2 * len(words))
                first.append(gram(bones.split(" ")[:3]))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("bones").filter(mask), pa.array(first, pa.int64()).filter(mask)], names=["response", "gram"])

    responses = groups.select("bones").mapInArrow(unusual, "response string, gram bigint").persist(StorageLevel.DISK_ONLY)
    whole = f.join(responses.select(F.col("response").alias("bones")), "bones", "left_semi").select("id", "field_name")

    # a table of CELLS bits tells most texts at once that no response begins in them
    marked = np.zeros(CELLS, bool)
    marked[responses.select(F.col("gram").bitwiseAND(CELLS - 1).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()] = True
    marked = spark.sparkContext.broadcast(np.packbits(marked))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(marked.value)
        for b in batches:
            of, out = [], []
            for i, t in enumerate(b.column("free").to_pylist()):
                words = t.split(" ")
                own = {g for j in range(len(words) - 2) if bits[(g := gram(words[j : j + 3])) & (CELLS - 1)]}
                of += [i] * len(own)
                out += own
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in ("id", "field_name", "free")], pa.array(out, pa.int64())], names=["id", "field_name", "free", "gram"])

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text, response in zip(b.column("free").to_pylist(), b.column("response").to_pylist()):
                at = f" {text} ".find(f" {response} ")
                keep.append(at >= 0 and not spoken_of(text[:at]))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(mask), b.column("field_name").filter(mask)], names=["id", "field_name"])

    within = f.select("id", "field_name", "free").mapInArrow(grams, "id string, field_name string, free string, gram bigint").join(responses, "gram").select("id", "field_name", "free", "response").mapInArrow(holds, "id string, field_name string")
    more = whole.unionAll(within).select("id", "field_name", F.lit("response").alias("kind"))
    found = found.unionAll(more).groupBy("id", "field_name").agg(F.sort_array(F.collect_set("kind")).alias("evidence"))  # a set of eight kinds at most
    return found.select("id", "field_name", F.col("evidence")[0].alias("kind"), "evidence")
