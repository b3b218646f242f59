"""Broken prompt and response pairs (problem 6).

A response is unwrapped and then tested for being empty, a refusal, a copy of the query, cut off,
or in another language.  Languages are compared by the posteriors of a naive Bayes model over
character n-grams; a cut-off end is told by how likely a text is to end after its last tokens.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import forget, materialize
from .dedupe import last_delivery
from .quality import COMMON
from .refusals import ANSWERS, EXAMPLES, RefusalModel, features
from .text import words

#: Frequent words of languages of which the documents hold no texts.
LEXICON = {
    "it": COMMON["it"] + " nella tabella documento legge valore richiesto questa pagina riga ultima indicato scritto accanto timbro risulta numero anche dove quando essere hanno viene dalla degli delle",
    "pt": COMMON["pt"] + " tabela documento valor pedido nesta página linha última indicado escrito ao lado carimbo resulta número também onde quando ser têm pelo pela numa outro além há lê",
    "nl": COMMON["nl"] + " tabel document staat gevraagde waarde deze bladzijde regel laatste vermeld geschreven naast stempel blijkt nummer waar wanneer zijn hebben wordt uit onder tussen geen andere",
    "pl": "w na i z do nie się to jest że od przez dla tej tym który która jako po za ale oraz lub przy był była tabeli dokumentu widać wartość podana stronie wierszu ostatnim liczba inna obok pieczęci napis tylko",
    "tr": "ve bir bu da de için ile olarak olan değil daha çok gibi kadar sonra ama veya ki ne var yok sayfada istenen değer yazılmıştır belgenin tablosunda son satırda başka sayı görülmektedir yanında damga",
    "sv": "och i att det som en på är av för med den till inte har de ett om men så kan från vid eller där när tabellen dokumentet står värdet sidan raden sista anges skrivet bredvid stämpeln numret",
    "el": "και το του η ο την της στον στην σε με για από που είναι δεν να τα των αυτή αυτό πίνακα εγγράφου γράφει τιμή ζητείται σελίδα τελευταία γραμμή αριθμός δίπλα σφραγίδα",
    "ar": "في من على إلى هذا هذه التي الذي هو هي أن لا ما كان عن مع القيمة المطلوبة الصفحة يظهر الجدول الأخير الوثيقة الرقم السطر بجانب الختم",
    "ko": "이 그 저 은 는 을 를 의 에 와 과 도 로 으로 에서 있습니다 입니다 없습니다 페이지에 적힌 값은 문서 표의 마지막 줄에는 라고 적혀 다른 숫자 옆에 도장",
    "zh": "的 是 了 在 不 和 有 这 上 个 我们 为 与 以 及 该页 所求 数值 文件 表格 最后 一行 写着 旁边 印章 其他 数字 没有 显示",
    "hi": "के का की में है हैं और यह वह से को पर नहीं एक ने भी इस पृष्ठ दस्तावेज़ तालिका मान अंतिम पंक्ति लिखा संख्या",
    "uk": "і в на не що з по для як але із за від це до ми його а так був була при або якщо сторінці документа таблиці значення вказано останній рядок число",
    "cs": "a v na se je že to z do s o k za po pro ale jako jsou nebo který tabulce dokumentu hodnota stránce řádku poslední uvedena číslo vedle razítka",
    "vi": "và của là có không được trong cho với này một những các trên trang tài liệu bảng giá trị dòng cuối cùng ghi số bên cạnh dấu",
}
#: Queries that ask for what is printed, word for word.
QUOTES = re.compile(r"exactly as (?:it is )?(?:printed|written)|as (?:they|it) stands?\b|\bquote\b|\bverbatim\b|word for word|what does the (?:notice|sign|label|note|stamp)\b.*\bsay|what is (?:written|printed) (?:in|on|above|below|under|beside)|wortwörtlich|im wortlaut|mot à mot|textuellement|tal cual|literalmente|al pie de la letra", re.I)
_TASK = r"(?:help|assist|answer|determine|read|view|see|provide|give|transcribe|access|process|identify|tell|say|guess|extract|share|comply|make out|do (?:that|this)|open|look|discuss|disclose|respond|complete|fulfil|analy[sz]e|recogni[sz]e|describe|reveal|state|report|name|decline|interpret|confirm|offer|supply)"
#: A plain form in which models decline, which labels responses for the classifier and is one of its features.
REFUSALS = re.compile(
    r"\bi(?:['’]m| am| was|['’]d)?\s+(?:sorry[,.]?\s+)?(?:but\s+)?(?:i\s+)?(?:afraid\s+)?(?:(?:can(?:no|['’])?t|can not|cannot|could not|couldn['’]t|won['’]t|will not|would not|wouldn['’]t|am not able to|['’]m not able to|not able to|unable to|am unable to|do not wish to|don['’]t want to|must decline to|must refuse to|(?:have to|need to) (?:decline|refuse)|decline to|refuse to|rather not|would rather not|prefer not to|not allowed to|not permitted to|not in a position to|not comfortable)\s*(?:really\s+|currently\s+|reliably\s+|to\s+)?" + _TASK + r"\b)"
    r"|\bi(?:['’]m| am) (?:not comfortable|not authori[sz]ed)\b"
    r"|\bi (?:do not|don['’]t) have (?:access|permission|the ability|enough information)\b"
    r"|\bi (?:must|have to|need to) (?:decline|refuse|pass)\b|\bi(?:['’]d| would) rather not\b|\bi (?:refuse|decline) to\b"
    r"|\b(?:not possible|impossible) for me to\b|\bno answer can be (?:provided|given)\b|\bcan(?:not|['’]t) be (?:answered|provided|determined) by me\b|\bbeyond (?:my|what i)\b"
    r"|\bas an? (?:\w+ )?(?:ai|assistant|language model)\b.*\b(?:not|cannot|can['’]t|decline|unable)\b|\bagainst my (?:guidelines|policy)\b"
    r"|\b(?:ich kann|kann ich|ich darf|darf ich|ich möchte|möchte ich|ich bin)\b.*\b(?:nicht|keine[nr]?|außerstande)\b|\bist (?:es )?mir nicht möglich\b|\bmuss ich (?:leider )?ablehnen\b|\bich muss .*ablehnen"
    r"|\bje (?:ne |n['’])?(?:peux|puis|suis|saurais|souhaite|dois|préfère|regrette)\b.*\b(?:pas|refuser|décliner|incapable|impossible)\b|\bm['’]est (?:pas possible|impossible)\b|\bje n['’]ai pas accès\b"
    r"|\bno (?:me es posible|puedo|podré|podría|tengo acceso|estoy (?:autorizad|en condiciones))|\b(?:debo|tengo que) (?:negarme|rechazar|declinar)\b|\bprefiero no\b|\bme resulta imposible\b"
    r"|\bя не могу\b|\bне имею доступа\b|\bвынужден[аы]? отказаться\b|\bnon posso\b|\bnão posso\b|\bik kan\b.*\bniet\b|お答えできません|読み取ることができません|できかねます",
    re.I,
)
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_FENCE = re.compile(r"^```[\w-]*\s*|\s*```$")
_LABEL = re.compile(r"^(?:\*\*|__)?\s*(?:(?:final |the )?answer|response|result|antwort|réponse|respuesta|ответ)\s*(?:\*\*|__)?\s*[:：]\s*(?:\*\*|__)?\s*", re.I)
_TAGGED = re.compile(r"^<(\w+)>(.*?)(</\1>)?$", re.S)
_NULLS = frozenset(("null", "none", "nil", "[]", "{}", '""', "''"))
_TOKEN = re.compile(r"\[[\d., ]+\]|[^\W\d_](?:[^\W_]|['’-](?=[^\W_]))*|[$€£]?\d(?:[\w.,:/%-]*[\w%])?|[^\w\s]")
_END = frozenset(".!?。！？…")


def unwrap(text: str | None) -> tuple[str, bool]:
    """What a response says without its wrapping, and whether the wrapping breaks off."""
    if text is None:
        return "", False
    core, broken = _INVISIBLE.sub("", text).replace("\xa0", " ").strip(), False
    for _ in range(3):
        before = core
        if core.startswith("```"):
            inner = _FENCE.sub("", core).strip()
            broken |= bool(inner) and not core.endswith("```")
            core = inner
        if core.startswith("{"):
            try:
                value = json.loads(core)
                values = [v for v in value.values()] if isinstance(value, dict) else [value]
                core = " ".join("" if v is None else str(v) for v in values).strip()
            except ValueError:
                inner = re.sub(r'^\{\s*"[^"]*"\s*:?\s*"?', "", core).rstrip('"} \n')
                broken |= bool(inner.strip()) and not core.endswith("}")
                core = inner.strip()
        tagged = _TAGGED.match(core)
        if tagged:
            core = tagged.group(2).strip()
            broken |= bool(core) and not tagged.group(3)
        core = _LABEL.sub("", core).strip()
        if len(core) > 1 and core[0] == core[-1] and core[0] in "\"'`*":
            core = core.strip(core[0]).strip()
        if core == before:
            break
    return core, broken


def is_empty(core: str) -> bool:
    """Whether nothing is said: no letter and no digit."""
    return core in _NULLS and core not in ("none", "nil") or not any(c.isalnum() for c in core)


def is_copy(core: str, theirs: list[str]) -> bool:
    """Whether a response only gives back the words of the query, once or again and again."""
    ours = words(core)
    if not theirs or len(ours) < len(theirs):
        return False
    rest = " ".join(ours) + " "
    asked = " ".join(theirs) + " "
    if asked not in rest:
        return False
    left = rest.replace(asked, "").split()
    known = {"the", "question", "is", "query", "you", "asked", "q", "a", "user", "prompt", "repeat", "your", "asks", "was", *theirs}
    return len(left) <= max(3, len(theirs) - 1) and all(w in known for w in left)


def tokens(core: str) -> list[str]:
    """Tokens of a text for the end model: words as they are, names and values as classes."""
    out: list[str] = ["<s>"]
    for t in _TOKEN.findall(core):
        if any(c.isdigit() for c in t):
            kind = "<value>"
        elif t[0].isupper():
            kind = "<name>"
        elif t == "&":
            kind = "<name>"
        else:
            kind = t
        if kind == "<name>" and out[-1] == "<name>":
            continue
        out.append(kind)
    if len(out) > 1 and out[1] == "<name>":
        out[1] = _TOKEN.findall(core)[0].lower() if len(out) > 3 else "<name>"
    return out


#: Between the tokens of a context in its text form; being white space it is in no token.
_GAP = "\x1f"


def end_counts(weighted: Iterable[tuple[str, int]], most: int = 4) -> tuple[Counter, Counter, Counter, Counter]:
    """How often contexts occur and end texts, and beginnings occur and belong to texts with a full stop."""
    total: Counter = Counter()
    end: Counter = Counter()
    started: Counter = Counter()
    stopped: Counter = Counter()
    for text, times in weighted:
        seen = tokens(text)
        for i in range(1, len(seen) + 1):
            for n in range(1, min(most, i) + 1):
                total[tuple(seen[i - n : i])] += times
        for n in range(1, min(most, len(seen)) + 1):
            end[tuple(seen[-n:])] += times
        if len(seen) > 5:
            started[tuple(seen[:3])] += times
            stopped[tuple(seen[:3])] += times * (seen[-1] in _END)
    return total, end, started, stopped


class EndModel:
    """How likely a text is to end after its last tokens."""

    def __init__(self, texts: Iterable[str], most: int = 4, least: int = 15) -> None:
        self._keep(*end_counts(((t, 1) for t in texts), most), most, least)

    @classmethod
    def of_counts(cls, total: dict, end: dict, started: dict, stopped: dict, most: int = 4, least: int = 15) -> EndModel:
        """The model of counts made elsewhere; those below ``least`` may be missing."""
        model = cls.__new__(cls)
        model._keep(total, end, started, stopped, most, least)
        return model

    def _keep(self, total: dict, end: dict, started: dict, stopped: dict, most: int, least: int) -> None:
        self.most, self.least = most, least
        kept = {k: n for k, n in total.items() if n >= least}
        self.total, self.end = kept, {k: end[k] for k in kept if end.get(k)}
        self.closes = {k: stopped.get(k, 0) / n for k, n in started.items() if n >= 2 * least}
        heads: Counter = Counter()
        for k, n in kept.items():
            if len(k) == 1 and k[0].isalpha():
                for i in range(1, len(k[0])):
                    heads[k[0][:i]] = max(heads[k[0][:i]], n)
        self.heads = dict(heads)

    def breaks_off(self, core: str, rare: float = 0.1) -> bool:
        """Whether a text ends where texts do not end."""
        seen = tokens(core)
        last = seen[-1]
        if last == "…" or core.endswith("..."):
            return True
        if last in _END or len(seen) < 4:
            return False
        if last in ",;:(" or last in "-–—&":
            return True
        # A word that hardly occurs but at ends, and that begins a far more frequent one, is a part of that.
        own = self.total.get((last,), 0)
        if last in self.heads and self.heads[last] > 20 * own and (not own or self.end.get((last,), 0) > 0.5 * own):
            return True
        for n in range(min(self.most, len(seen)), 0, -1):
            context = tuple(seen[-n:])
            count = self.total.get(context)
            if count:
                return max(0, self.end.get(context, 0) - 1) / count < rare and (n > 1 or last not in ("<value>", "<name>"))
        return len(seen) > 6 and self.closes.get(tuple(seen[:3]), 0.0) > 0.9


#: Character n-grams that each language is taken to have been seen in.
ASSUMED = 3000


class LanguageModel:
    """Naive Bayes over the character n-grams of words, one class per language."""

    def __init__(self, samples: dict[str, list[str]], smooth: float = 0.2, more: dict[str, Counter] | None = None) -> None:
        """``more`` has n-grams, already counted, beside those of the words."""
        self.names = sorted(samples)
        grams: list[Counter] = []
        for name in self.names:
            c: Counter = Counter()
            for word, n in Counter(samples[name]).items():
                for g in self.grams(word):
                    c[g] += n
            c.update((more or {}).get(name, {}))
            grams.append(c)
        known = set().union(*grams) if grams else set()
        # Every language counts as one text of the same length, or the least known would win all rare words.
        bottom = ASSUMED + smooth * len(known)
        scale = np.array([ASSUMED / max(1, sum(c.values())) for c in grams])
        self.unseen = np.full(len(grams), math.log(smooth / bottom))
        self.logs = {g: np.log((np.array([c[g] for c in grams]) * scale + smooth) / bottom) for g in known}
        self.words: dict[str, np.ndarray] = {}

    @staticmethod
    def grams(word: str) -> list[str]:
        """The bigrams and trigrams of a word with its bounds."""
        w = f" {word} "
        return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]

    def score(self, found: list[str]) -> np.ndarray:
        """Log-likelihood of the words under each language."""
        total = np.zeros(len(self.names))
        for w in found:
            s = self.words.get(w)
            if s is None:
                s = sum((self.logs.get(g, self.unseen) for g in self.grams(w)), np.zeros(len(self.names)))
                if len(self.words) < 200_000:
                    self.words[w] = s
            total = total + s
        return total

    def language(self, found: list[str]) -> str:
        """The most likely language."""
        return self.names[int(np.argmax(self.score(found)))]


_PLAIN = re.compile(r"[^\W\d_]+")


def language_words(text: str) -> list[str]:
    """The words that tell a language: no names, no values; the first word of a sentence stays."""
    out, start = [], True
    for m in _PLAIN.finditer(text):
        w = m.group()
        if w[0].islower() or w[0].lower() == w[0].upper() or (start and not w.isupper()):
            out.append(w.lower())
        start = False
    return out


def other_language(found: list[str], asked: np.ndarray, said: np.ndarray, margin: float = 6.0) -> bool:
    """Whether a response's words are in another language than the query.

    ``asked`` and ``said`` are the log-posteriors of the two texts.  They are in different languages
    if no language is within ``margin`` of the best for both.
    """
    if (len(found) < 3 and not any(ord(c) > 0x2FF for w in found for c in w)) or sum(map(len, found)) < 6:
        return False
    reach = max(margin, 0.6 * len(found))
    shared = (asked >= asked.max() - margin) & (said >= said.max() - reach)
    return not shared.any()


#: Words of which a response in that form has at least one: a cheap test before the patterns.
_HINTS = frozenset("i me i'm i’m i'd i’d i've my ai assistant ich mir je j no puedo prefiero debo imposible posible я не non não ik m'est m’est".split())


def has_form(core: str) -> bool:
    """Whether a response has the plain form of declining."""
    return (not _HINTS.isdisjoint(core.lower().split()) or not core.isascii()) and REFUSALS.search(core) is not None


def refusal_features(core: str) -> set[str]:
    """The features of a response for the classifier of refusals."""
    return features(tokens(core.replace("’", "'")), has_form(core))


def example_features() -> tuple[list[set[str]], list[set[str]]]:
    """The features of the labelled examples: refusals and answers."""
    return tuple([refusal_features(text) for texts in listed.values() for text in texts] for listed in (EXAMPLES, ANSWERS))


class Tester:
    """Finds the defect of pairs; keeps what it learnt about texts and queries it met before."""

    def __init__(self, ends: EndModel, model: LanguageModel, refusals: RefusalModel, keep: int = 50_000) -> None:
        self.ends, self.model, self.refusals, self.keep = ends, model, refusals, keep
        self.texts: dict[str | None, tuple] = {}
        self.queries: dict[str, tuple] = {}

    def _text(self, text: str | None) -> tuple:
        known = self.texts.get(text)
        if known is None:
            core, broken = unwrap(text)
            if is_empty(core):
                known = (core, "empty", False, [], None)
            else:
                refused = self.refusals.declines(refusal_features(core))
                found = language_words(core)
                known = (core, "refusal" if refused else None, broken or self.ends.breaks_off(core), found, self.model.score(found) if found else None)
            if len(self.texts) >= self.keep:
                self.texts.clear()
            self.texts[text] = known
        return known

    def _query(self, query: str) -> tuple:
        known = self.queries.get(query)
        if known is None:
            asked = language_words(query)
            known = (QUOTES.search(query) is not None, words(query), self.model.score(asked) if len(asked) > 1 else None)
            if len(self.queries) >= self.keep:
                self.queries.clear()
            self.queries[query] = known
        return known

    def defect(self, query: str | None, text: str | None, page: str | None = None) -> tuple[str | None, str | None]:
        """The defect of one pair, if any, and what to look up among page texts before it counts.

        ``page`` is what the page asked about is known to bear.  In answers to queries that ask for a
        quotation it counts as a name, whatever it says, unless it is a refusal itself.
        """
        core, plain, cut, found, said = self._text(text)
        if plain == "empty":
            return "empty", None
        quotes, theirs, asked = self._query(query or "")
        look = page_key(core) if quotes else None
        if quotes and page is not None:
            own = page_key(self._text(page)[0])
            if len(own) > 2 and not has_form(own):
                if look == own:
                    return None, None
                bare = re.sub(re.escape(own), "Value", core, flags=re.I)
                if bare != core:
                    core, plain, cut, found, said = self._text(bare)
                elif (shared := shared_run(core, self._text(page)[0])) is not None:
                    # Words that both quote tell nothing about the language that a response is in.
                    *_, found, said = self._text(core.replace(shared, "Value"))
        if plain:
            return plain, look
        if theirs and len(core) * 2 > len(query) and is_copy(core, theirs):
            return "copy", look
        if cut:
            return "truncated", look
        return ("language", look) if asked is not None and said is not None and other_language(found, asked, said) else (None, None)


def shared_run(core: str, page: str, least: int = 3) -> str | None:
    """The longest run of at least ``least`` words that two texts share, as it stands in the first."""
    ours, theirs = core.split(), page.split()
    match = SequenceMatcher(None, [w.lower() for w in ours], [w.lower() for w in theirs], autojunk=False).find_longest_match()
    run = " ".join(ours[match.a : match.a + match.size])
    return run if match.size >= least and run in core else None


def page_key(core: str) -> str:
    """The form in which texts of pages are compared."""
    return core.strip(" .").lower()


def smallest_hashes(rows: DataFrame, identity: str, size: int) -> DataFrame:
    """The ``size`` rows with the smallest hashes of their ids, ties by id.

    Hashes are uniform, so of many rows those below twice the share wanted are enough to sort.
    """
    space = 1 << 40
    hashed = rows.withColumn("__h", F.pmod(F.xxhash64(identity), F.lit(space)))
    total = rows.count()
    if total > 4 * size:
        hashed = hashed.where(F.col("__h") < F.lit(int(2 * size * space / total)))
    return hashed.orderBy("__h", identity).limit(size).drop("__h")


def training_words(documents: DataFrame, texts: int = 3000) -> dict[str, list[str]]:
    """Words by language, from at most ``texts`` documents that say their language.

    A bounded sample of labelled rows, as the model has few parameters: the whole texts of the
    documents with the smallest hashes of their ids, whose words are counted in the cluster.
    """
    tag = F.substring(F.lower(F.trim("lang")), 1, 2)
    known = documents.where(tag.rlike("^[a-z]{2}$") & (F.lower(F.trim("lang")) != "und") & F.col("text").isNotNull())
    picked = smallest_hashes(known.select(tag.alias("lang"), "text", "doc_id"), "doc_id", texts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter((lang, w) for lang, t in zip(frame["lang"], frame["text"], strict=True) for w in (m.group() for m in _PLAIN.finditer(t)) if w[0].islower() or w[0].lower() == w[0].upper())
            yield pd.DataFrame([(lang, w, n, 0) for (lang, w), n in seen.items()], columns=COUNTED.names)

    counted: dict[str, Counter] = {}
    for lang, word, n in picked.mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n")).collect():
        counted.setdefault(lang, Counter())[word] = n
    # Wrong labels are few: a word counts for a language that has at least a tenth of its uses.
    uses: Counter = sum(counted.values(), Counter())
    out: dict[str, list[str]] = {lang: [w for w, n in c.items() for _ in range(n) if 10 * n >= uses[w]] for lang, c in counted.items()}
    for lang, listed in LEXICON.items():
        out.setdefault(lang, []).extend(listed.split() * 3)
    for lang, listed in COMMON.items():
        out.setdefault(lang, []).extend(listed.split() * 3)
    return {lang: ws for lang, ws in out.items() if ws}


COUNTED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType())])


def with_queries(samples: dict[str, list[str]], queries: DataFrame) -> LanguageModel:
    """The model of ``samples``, refitted with all distinct queries, each in the language it tells for it.

    N-grams are counted where the queries are and meet summed: there are no more than the scripts have.
    """
    first = LanguageModel(samples)
    shared = queries.sparkSession.sparkContext.broadcast({"names": first.names, "unseen": first.unseen, "logs": first.logs})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageModel.__new__(LanguageModel)
        model.__dict__.update(shared.value, words={})
        for frame in frames:
            seen: Counter = Counter()
            for query in frame["query"]:
                found = language_words(query)
                if len(found) > 2:
                    lang = model.language(found)
                    seen.update((lang, g) for w in found for g in model.grams(w))
            yield pd.DataFrame([(lang, g, n, 0) for (lang, g), n in seen.items()], columns=COUNTED.names)

    more: dict[str, Counter] = {}
    distinct = queries.where("query is not null").select("query").distinct()
    for kind, key, n in distinct.mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n")).collect():
        more.setdefault(kind, Counter())[key] = n
    return LanguageModel(samples, more=more)


def fit_ends(texts: DataFrame, text: str, most: int = 4, least: int = 15) -> EndModel:
    """The end model of all texts, each distinct one counted with its multiplicity.

    Only contexts found ``least`` times in all texts reach the driver: as many are evidence enough
    at any size of the input, so more texts only make more contexts known.
    """
    many = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("n"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cores = ((*unwrap(t), n) for t, n in zip(frame["text"], frame["n"].tolist(), strict=True))
            total, end, started, stopped = end_counts(((c, n) for c, broken, n in cores if c and not broken), most)
            yield pd.DataFrame([(kind, _GAP.join(k), n, part.get(k, 0)) for kind, whole, part in (("end", total, end), ("start", started, stopped)) for k, n in whole.items()], columns=COUNTED.names)

    summed = many.mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") >= least)
    counts: dict[str, tuple[dict, dict]] = {"end": ({}, {}), "start": ({}, {})}
    for kind, key, n, m in summed.collect():
        context = tuple(key.split(_GAP))
        counts[kind][0][context], counts[kind][1][context] = n, m
    return EndModel.of_counts(*counts["end"], *counts["start"], most, least)


def fit_refusals(responses: DataFrame, correct: int = 20_000, wrong: int = 200_000) -> RefusalModel:
    """The classifier of refusals, from a bounded sample of labelled responses.

    ``responses`` has response and right.  Answers are distinct responses marked correct; refusals are
    distinct responses never marked correct that have the plain form of declining; ``correct`` and
    ``wrong`` bound how many of either are looked at, those with the smallest hashes.  Features are
    counted in the cluster.
    """
    texts = responses.where(F.col("response").isNotNull() & (F.col("response") != "")).groupBy("response").agg(F.max(F.coalesce("right", F.lit(False))).alias("right"))
    texts = materialize(texts, "responses")
    picked = smallest_hashes(texts.where("right"), "response", correct).unionByName(smallest_hashes(texts.where("not right"), "response", wrong))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[str, Counter] = {"refused": Counter(), "answered": Counter()}
            for text, right in zip(frame["response"], frame["right"], strict=True):
                core, _ = unwrap(text)
                if core and right != has_form(core):
                    kind = "answered" if right else "refused"
                    seen[kind].update(refusal_features(core))
                    seen[kind]["\x1d"] += 1
            yield pd.DataFrame([(kind, g, n, 0) for kind, c in seen.items() for g, n in c.items()], columns=COUNTED.names)

    counts: dict[str, Counter] = {"refused": Counter(), "answered": Counter()}
    for kind, key, n in picked.select("response", "right").mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n")).collect():
        counts[kind][key] = n
    forget(texts)
    refused, answered = counts["refused"], counts["answered"]
    n, m = refused.pop("\x1d", 0), answered.pop("\x1d", 0)
    return RefusalModel.of(refused, answered, n, m, example_features())


FOUND = T.StructType([T.StructField(c, T.StringType()) for c in ("origin", "pair_key", "defect", "look")])


def pairs(samples: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold pairs and run pairs: origin, pair_key, query, response, and of runs the sample's own gold as page.

    Of several deliveries of a sample or a run the last counts.  Runs of unknown samples and
    inferred results are no pairs.
    """
    gold = last_delivery(samples.where(F.col("sample_id").isNotNull()), ["sample_id"], ["ingested_at"], ["sample_id", "query", "gt_answer"])
    runs = last_delivery(results.where((F.col("result_type") == "observed") & F.col("result_id").isNotNull()), ["result_id"], ["ingested_at"], ["result_id", "sample_id", "predicted_answer", "is_correct"])
    asked = runs.join(gold, "sample_id")
    one = gold.select(F.lit("gold").alias("origin"), F.col("sample_id").alias("pair_key"), "query", F.col("gt_answer").alias("response"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("boolean").alias("right"))
    two = asked.select(F.lit("run").alias("origin"), F.col("result_id").cast("string").alias("pair_key"), "query", F.col("predicted_answer").alias("response"), F.when(_quoting(F.col("query")), F.col("gt_answer")).alias("page"), F.col("is_correct").alias("right"))
    return one, two


def _quoting(query: Column) -> Column:
    return query.rlike("(?i)" + QUOTES.pattern)


def page_texts(samples: DataFrame) -> DataFrame:
    """``look``: every text that is the gold answer of several queries asking for a quotation."""
    asked = samples.where(_quoting(F.col("query")) & F.col("gt_answer").isNotNull()).select("gt_answer", "sample_id").distinct()
    borne = asked.groupBy("gt_answer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gt_answer")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [page_key(unwrap(t)[0]) for t in frame["gt_answer"]]
            yield pd.DataFrame({"look": [k for k in found if len(k) > 2 and not has_form(k)]}, dtype=object)

    return borne.mapInPandas(keys, "look string").distinct()


def broken_pairs(samples: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """``(origin, pair_key, defect)`` of every broken pair, at most one defect each.

    The end model is fitted on the responses of all pairs, the language model extended by all their
    queries, the classifier of refusals fitted on a bounded sample of labelled responses.  In answers to queries that ask for a quotation, what the sample's own gold answer says
    counts as a name; a response that is itself a page text, being the gold answer of several such
    queries, is no case.  Page texts are met by a join of the few pairs found with all of them.
    Every pair is tested, a null query like an empty one.
    """
    spark = samples.sparkSession
    one, two = pairs(samples, results)
    both = materialize(one.unionByName(two), "pairs")
    ends = fit_ends(both, "response")
    model = with_queries(training_words(documents), samples.select("query"))
    refusals = fit_refusals(both.where("origin = 'run'").select("response", "right"))
    # As plain values, since a broadcast travels without this package.
    shared = spark.sparkContext.broadcast((ends.__dict__, {"names": model.names, "unseen": model.unseen, "logs": model.logs}, refusals.__dict__))

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end_state, model_state, refusal_state = shared.value
        ends, model, refusals = EndModel.__new__(EndModel), LanguageModel.__new__(LanguageModel), RefusalModel.__new__(RefusalModel)
        ends.__dict__.update(end_state)
        model.__dict__.update(model_state, words={})
        refusals.__dict__.update(refusal_state)
        tester = Tester(ends, model, refusals)
        for frame in frames:
            told = [tester.defect(q, t, p) for q, t, p in zip(frame["query"], frame["response"], frame["page"], strict=True)]
            found = pd.DataFrame({"origin": frame["origin"], "pair_key": frame["pair_key"], "defect": [d for d, _ in told], "look": [x for _, x in told]}, dtype=object)
            yield found[found["defect"].notna()]

    found = both.mapInPandas(test, FOUND)
    return found.join(page_texts(samples), "look", "left_anti").select("origin", "pair_key", "defect")
