"""Template residue, filler, error pages and script notices in place of content.

Every text is read once. Detectors find unfilled placeholders, field labels with a
null value and filler, the latter by what it lacks: words of form, and variety.
Error pages and notices are told by comparing terms: those of the title (which
stands for the address slug too, the records carry none) with those of the body,
and both with the vocabulary that systems speak about themselves. A passage that
is nearly all such vocabulary is a response by itself; one that is so in part is
one if its masked form comes back under several titles it has nothing to do with,
counted per host and over hosts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# ---- fixed values: notations of placeholders; a field name is letters and underscores ----
_NAME = r"[A-Za-z][A-Za-z_]{2,}"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{%\s*{_NAME}\s*%\}}|(?<![{{$\\\w])\{{{_NAME}\}}(?!\}})|<<\s*{_NAME}\s*>>"
    rf"|(?<!<)<(?!/?(?:html|head|title|body|h[1-6]|div|span|table|br|hr|img|pre|code|sub|sup|strong|script|style|link|meta|form|input)\b){_NAME}>(?!>)"
    rf"|(?<![\w%])%{_NAME}%(?![\w%])|(?<![\w#])#{_NAME}#(?![\w#])|(?<![\w])__{_NAME}__(?!\w)"
    r"|\[\s*(?:insert|enter|add|your)\s[^\]\n]{1,60}\]|\[[A-Z][A-Z_ ]+\s(?:TBD|TBA|TODO)\]|\[\s*(?:(?:first|last|full|user|company|job)[ _])?(?:name|company|date|title|address|e?-?mail|phone|city|organi[sz]ation|department|position|subject|amount)\s*\]",
    re.IGNORECASE,
)
OPENERS = re.compile(r"[{<%#_\[]")
NO_VALUE = r"(?:null|none|nan|undefined|\[object Object\]|n/a|nil)"
FIELD = re.compile(rf"^\W{{0,3}}[A-Z][A-Za-z_]*(?: [A-Z][A-Za-z_]*){{0,2}}\s?[:=]\s*{NO_VALUE}\W{{0,2}}$", re.IGNORECASE)
FIELD_INLINE = re.compile(rf"\b[A-Z][A-Za-z_]*(?: [A-Z][A-Za-z_]*)?: {NO_VALUE}(?=\s|$)")
#: Words of those who write about placeholders instead of leaving them unfilled.
ABOUT = frozenset("template templates placeholder placeholders syntax engine variable variables macro macros expand expanded expands render rendered parser parsed notation latex markup written literal escape escaped substitute substituted replaces token tokens".split())
# ---- fixed values: the words of the traditional filler passage ----
FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
    esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
#: Those of them that no other language of a corpus uses as words of form.
LATIN = FILLER - frozenset("do ut et ad ex ea in esse eu non sed sit id est qui sint sunt elit".split())
# ---- fixed values: words of form of the corpus's languages, which filler lacks and terms leave out ----
FORM = frozenset(
    """a an the of for and in on to with by at from as is are was were be been has have had do does did will would can cannot could may might must shall should not no nor or but if than then that this these those it its we our you your they their he she his her there here who which what when where why how all any each some such so too very more most about after before between into over under out up down off again per via one two us me my i
    der die das den dem des ein eine einer eines und oder nicht kein keine mit von zu zur zum für auf im in ist sind war waren wird werden sie ihr ihre wir es dass bei nach aus am als auch
    le la les un une des du de et ou ne pas par pour sur dans est sont au aux ce cette ces il elle nous vous votre vos qui que en avec plus puis se sa son ses
    el los las una unos del y o no por para con en es son al su sus que se lo como más este esta estos
    यह वह है हैं था के का की को से में पर और या ने एक इस उस हो गया गई जा रहा रहे करें कर लिए तो भी""".split()
)
# ---- fixed values: how systems speak about themselves. Beginnings of words; those of up to four letters stand for themselves and their endings ----
#: What the notice is about.
SUBJECT = tuple(
    """page site website webpage server service session request gateway browser javascript script cookie access account login connection database url resource content portal application host proxy upstream captcha human robot address link profile directory
    seite server dienst sitzung anfrage zugriff browser verbindung inhalt datei
    serveur session requête accès navigateur connexion contenu fichier adresse
    página servidor servicio sesión solicitud acceso navegador conexión contenido dirección sitio
    पृष्ठ सर्वर सेवा सत्र अनुरोध ब्राउज़र कुकी जावास्क्रिप्ट स्क्रिप्ट""".split()
)
#: What is wrong with it.
FAULT = tuple(
    """error bad fail fault exception invalid expire timeout timed unavailable unable missing forbidden denied unauthori unreachable refused blocked disabled required requires maintenance construction temporar redirect loading overload crash corrupt broken soon coming
    fehler abgelaufen gesperrt verweigert ungültig gefunden nötig erforderlich wartung
    erreur expiré introuvable interdit refusé indisponible exige nécessite requiert trouvé
    error caducad expirad prohibid denegad encontr disponible requier necesit
    त्रुटि उपलब्ध समाप्त नहीं मिला अस्वीकृत""".split()
)
#: What the reader is to do about it.
ORDER = tuple(
    """please enable activate allow sign retry try reload refresh return check verify confirm accept agree consent continue click wait persist minute second later switch turn cookies ray back home administrator support moved existed moment use private secure shown slow works best establish
    bitte aktivieren anmelden versuchen prüfen laden zustimmen später schalten erneut
    veuillez activez activer connectez reconnectez réessayez rechargez vérifiez acceptez tard
    favor active habilite inicie inténtelo intente recargue verifique acepte tarde nuevo
    कृपया बाद प्रयास लॉग पुनः सक्षम जाँच""".split()
)
#: Status lines and the traces of programs.
STATUS = re.compile(r"\b(?:http|error|erreur|fehler|status|code|त्रुटि)\W{0,3}[45]\d\d\b|^\W*[45]\d\d\b|\([45]\d\d\)", re.IGNORECASE)
TRACE = re.compile(r"^traceback \(most recent call last\)|^\w*(?:error|exception): .+$|^file \"[^\"]+\", line \d+|^at [\w.$<>]+ ?\([^)]*:\d+(?::\d+)?\)\W*$|^(?:fatal|uncaught|unhandled) \w*(?:error|exception)\b", re.IGNORECASE)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
CODE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b|\d+")

PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?।…])\s+|\s*\n+\s*")
WORD = re.compile(r"[^\W\d_]+(?:[ऀ-ॣ]+[^\W\d_]*)*")
#: Parts of a passage's terms that are system vocabulary: enough by themselves, and enough beside evidence of the corpus.
ALONE, BESIDE = 0.75, 0.4


@lru_cache(maxsize=200_000)
def word_class(word: str) -> int:
    """0 a term of its own, 1 a word of form, 2 subject, 3 fault, 4 order."""
    if word in FORM:
        return 1
    for k, stems in ((2, SUBJECT), (3, FAULT), (4, ORDER)):
        for stem in stems:
            if word.startswith(stem) and (len(stem) > 4 or word[len(stem) :] in ("", "s", "ed", "es", "ing")):
                return k
    return 0


def system_share(passage: str) -> tuple[float, bool]:
    """The part of a passage's terms that systems use about themselves, and whether they make up a message: a fault or an order beside something it is about."""
    subject = fault = order = own = 0
    start = True
    for w in WORD.finditer(passage):
        word = w.group()
        # names within a sentence are no terms
        named = word[0].isupper() and not start and w.start() > 1 and passage[w.start() - 2] not in ".!?:।>"
        start = False
        k = word_class(word.lower())
        if k == 0 and not (named and not word.isupper()):
            own += 1
        subject, fault, order = subject + (k == 2), fault + (k == 3), order + (k == 4)
    status = len(STATUS.findall(passage))
    fault += status
    said = subject + fault + order
    share = said / max(1, said + own)
    return share, said >= 2 and (fault > 0 or (subject > 0 and order > 0))


def _about(sentence: str) -> bool:
    """A sentence that speaks of placeholders."""
    return any(w.lower() in ABOUT for w in WORD.findall(PLACEHOLDER.sub(" ", sentence)))


def _filler(found: list[str]) -> bool:
    """Eight words or more without a word of form between them, of which one in seven at least is of the traditional passage, or which are twenty at least of few kinds."""
    run: list[str] = []
    for w in [*found, "the"]:
        if w in FORM and w not in LATIN:
            if len(run) >= 8:
                latin = sum(x in LATIN for x in run)
                if latin >= 2 and latin * 7 >= len(run) or (len(run) >= 20 and len(set(run)) * 2 <= len(run) and latin):
                    return True
            run = []
        else:
            run.append(w)
    return False


def _masked(passage: str) -> str:
    """A passage as a host's template would give it: lower case, with numbers, codes and names within sentences masked."""
    t = CODE.sub("0", passage)
    t = re.sub(r"(?<=[^\W\d_A-Z] )[A-Z][^\W\d_]+", "X", t)
    return re.sub(r"\s+", " ", t).strip().lower()


def _terms(text: str) -> set[str]:
    return {w for w in (x.lower() for x in WORD.findall(text)) if len(w) >= 4 and w not in FORM}


def read_text(text: str | None, title: str | None) -> tuple[str, list[tuple[str, bool]]]:
    """The kind of residue a text holds by itself (placeholder, field, filler, notice or ''), and else its passages (masked, mismatched) that evidence of the corpus must decide. The whole text is looked at."""
    if not text:
        return "", []
    doubtful: list[tuple[str, bool]] = []
    words: list[str] = []
    for paragraph in PARAGRAPH.split(text):
        plain = TAG.sub(" . ", paragraph) if "</" in paragraph else paragraph
        passages = []
        for sentence in SENTENCE.split(paragraph):
            s = sentence.strip(" \t\r-*•·")
            if not s:
                continue
            if OPENERS.search(s) and PLACEHOLDER.search(s) and not _about(s):
                return "placeholder", []
            if ":" in s and (FIELD.match(s) or len(FIELD_INLINE.findall(s)) >= 2):
                return "field", []
            if TRACE.match(s):
                return "notice", []
            if "|" not in s:  # lines of links say nothing by themselves
                passages.append(s)
        low = plain.lower()
        found = WORD.findall(low)
        words += found
        classes = sum(word_class(w) >= 2 for w in found)
        if classes + len(STATUS.findall(plain)) < 2:
            continue
        for passage in ([plain] if len(passages) > 1 or plain is not paragraph else []) + passages:
            share, message = system_share(passage)
            if not message:
                continue
            if share >= ALONE:
                return "notice", []
            if share >= BESIDE:
                doubtful.append((_masked(passage), not title or not _terms(passage) & _terms(title)))
    return ("filler", []) if _filler(words) else ("", doubtful)


def residue_kind(text: str | None) -> str:
    """The kind of residue a text holds whatever the corpus says."""
    return read_text(text, None)[0]


def residue(documents: DataFrame, least_titles: int = 3) -> DataFrame:
    """Documents with residue: doc_id, kind (placeholder, field, filler, notice, response).

    A response is a passage partly in system vocabulary whose masked form comes
    under at least `least_titles` different titles of one host, or as many titles
    of several hosts together, and which shares no term with its own title. The
    text is read once; only doubtful passages and verdicts are kept, and their
    titles counted over the whole corpus, equal ones combined on the map side.
    Null and empty texts are no residue; null titles are no evidence; repeated ids
    appear once; an empty table gives no rows; other columns are ignored.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, titles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, title in zip(ids, batch.column(1), titles):
                kind, doubtful = read_text(text.as_py(), title)
                if kind:
                    rows.append((doc, kind, None, None))
                rows += [(doc, "", title, form) for form, mismatched in dict(doubtful).items() if mismatched]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "kind", "title", "form"])

    judged = cut(documents.select("doc_id", "text", F.col("title").cast("string").alias("title")).mapInArrow(run, f"doc_id {id_type}, kind string, title string, form string"))
    known = judged.filter("kind <> ''").select("doc_id", "kind")
    doubtful = judged.filter("kind = ''").select("doc_id", "title", F.xxhash64("form").alias("form"))
    served = doubtful.groupBy("form").agg(F.countDistinct("title").alias("titles")).filter(F.col("titles") >= least_titles)
    responses = doubtful.join(served, "form", "left_semi").select("doc_id", F.lit("response").alias("kind"))
    return known.unionByName(responses).groupBy("doc_id").agg(F.min("kind").alias("kind"))


def without_residue(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents of `found`."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
