"""PII: detected entities get keyed surrogates of the same type, format, gender and script; distinct entities stay distinct.

*Entities.* Secrets (a value assigned to a name like token, password, api_key, or with a well-known prefix); e-mail addresses; IPv4 and IPv6 addresses; IBANs;
payment-card numbers (13 to 19 digits that begin with 2 to 6 and pass Luhn's check, or digits grouped as on a card); US social security numbers; telephone
numbers (international, bracketed or separated, or 10 plain digits that are a North American number); and names of persons: the whole name after a title (Mr, Frau, Madame, Señora,
Г-н ...), listed or not, with particles, initials and hyphens, in scripts with and without case; or a given and a family name that are both listed. A bare word is never taken for a
name. Where kinds overlap, the earlier in this list and the longer wins.

*Surrogates.* Each is a function of the secret ``key``, the kind and the entity's canonical form (a number's digits without its punctuation, a lower-case
address, the full form of an IPv6 address, ...), so an entity gets the same surrogate wherever and however it is written (coreference), and nothing has to be looked up.
Digits are encrypted by a keyed Feistel permutation of numbers of that length, laid into the entity's own punctuation; the permutation
is walked until the surrogate is fit: cards keep their first digit and Luhn's check, IBANs their country and a check sum of 1 modulo 97, telephone numbers their country code, prefixes
and the first digit after them, social security numbers stay assignable, and addresses stay private, local, reserved or public. Letters of an address or secret are permuted within
their class. Every part of a name becomes one of the same script and, for given names, gender (that of the title, or else of the listed given name); particles stay, initials become
initials, case and spacing are kept.

*Collisions.* Permutations of whole forms can't map two entities onto one surrogate. But domains of e-mail addresses lose their last label, name lists are finite, and a surrogate may be another
entity of the corpus. So a first pass collects the distinct entities, finds each surrogate that two of them share or that is
itself an entity, and gives all but the least of those that share it the next ``attempt``, until there are none. Only entities with another attempt
than 0 (rare) go back to the second pass, by broadcast if they are at most ``broadcast_exceptions``, else by a join with the
documents. When a name list is exhausted, initials are added.

*At scale.* Two reads of the text, no shuffle of it (unless exceptions must be joined); the shuffle holds distinct entities. Texts, whole ones of any length, are first
searched by automata that tell which kinds they may have; only those kinds are looked for in Python.

*Odd input.* Null texts stay null; empty ones, and texts without entities, are returned as they are. Rows with null or repeated ids
are rewritten like any other (ids play no part, and may have any type). Ties don't occur: the least form, then kind, of those that share a surrogate keeps it. Extra columns
pass through, whatever their names; a column ``n_entities`` is replaced. Empty tables stay empty.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import column, cut, extended, fresh, quoted

GIVEN = {
    ("latin", "f"): "Alice Amanda Amélie Ana Andrea Angela Anna Barbara Beatriz Camille Carla Carmen Catherine Charlotte Chloé Christine Clara Claire Claudia Cristina Daniela Deborah Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Eva Fatima Florence Franziska Gabriela Giulia Grace Hannah Heike Helen Helena Ingrid Irene Isabel Isabelle Jane Jennifer Jessica Johanna Josephine Juana Julia Julie Karen Katharina Katherine Laura Lauren Lena Linda Lisa Louise Lucía Lucie Magdalena Margaret Maria María Marie Marta Martha Mary Megan Michelle Monica Nadia Natalie Nathalie Nicole Olivia Patricia Paula Petra Pilar Rachel Rebecca Renate Rosa Ruth Sabine Sandra Sara Sarah Sofia Sophie Stephanie Susan Susanne Sylvie Teresa Ursula Valentina Valérie Vanessa Victoria Virginie".split(),
    ("latin", "m"): "Adam Alain Alan Albert Alejandro Alexander Alfonso Andreas Andrew Anthony Antoine Antonio Arthur Benjamin Bernard Brian Bruno Carlos Charles Christian Christopher Daniel David Diego Dieter Dominik Donald Edward Eduardo Enrique Eric Étienne Felipe Felix Fernando Francisco François Frank Franz Gabriel George Gérard Gregory Guillaume Günter Hans Harold Heinrich Henry Hugo Ivan Jacob Jacques Jaime James Jason Javier Jean Jeffrey Johann John Jonathan Jorge José Joseph Juan Julien Jürgen Karl Kenneth Kevin Klaus Laurent Louis Luca Lucas Luis Manuel Marc Marco Mario Mark Markus Martin Matthew Michael Michel Miguel Nicolas Oliver Olivier Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Raymond Richard Robert Roberto Roger Ronald Samuel Scott Sebastian Simon Stefan Stephen Steven Thomas Timothy Tobias Victor Vincent Walter Werner William Wolfgang".split(),
    ("cyrillic", "f"): "Александра Алина Алла Анастасия Анна Валентина Валерия Вера Виктория Галина Дарья Евгения Екатерина Елена Жанна Зоя Инна Ирина Кира Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Тамара Татьяна Ульяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Леонид Максим Михаил Никита Николай Олег Павел Пётр Роман Сергей Степан Тимофей Фёдор Юрий".split(),
    ("greek", "f"): "Αγγελική Αικατερίνη Αναστασία Άννα Βασιλική Γεωργία Δέσποινα Ειρήνη Ελένη Ευαγγελία Ζωή Θεοδώρα Ιωάννα Μαρία Παναγιώτα Παρασκευή Σοφία Σταυρούλα Φωτεινή Χριστίνα".split(),
    ("han", "f"): "芳 娜 敏 静 秀英 丽娟 桂兰 玉梅 淑华 红霞 春燕 雪 婷婷 佳怡 思琪 晓红".split(),
    ("han", "m"): "伟 强 磊 军 志强 建国 国华 文杰 明辉 俊杰 海涛 鹏 浩然 子轩 立新 永强".split(),
    ("hangul", "f"): "지영 미경 수진 은주 서연 하은 민서 지우 유진 혜진".split(),
    ("hangul", "m"): "민준 서준 도윤 성호 영수 정훈 준호 현우 지훈 동현".split(),
    ("arabic", "f"): "فاطمة مريم عائشة زينب خديجة ليلى سارة نور هدى سلمى".split(),
    ("arabic", "m"): "محمد أحمد علي حسن حسين يوسف إبراهيم خالد عمر سعيد".split(),
    ("hebrew", "f"): "שרה רבקה רחל לאה מרים אסתר חנה דבורה נועה תמר".split(),
    ("hebrew", "m"): "אברהם יצחק יעקב משה דוד יוסף דניאל שמואל אליהו יונתן".split(),
    ("devanagari", "f"): "प्रिया अनीता सुनीता पूजा नेहा मीना कविता राधा सीमा गीता".split(),
    ("devanagari", "m"): "राहुल अमित विजय संजय राजेश अनिल सुनील रवि मोहन अर्जुन".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Αντώνιος Βασίλειος Γεώργιος Δημήτριος Εμμανουήλ Ευάγγελος Θεόδωρος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Παύλος Πέτρος Σπυρίδων Χαράλαμπος Χρήστος".split(),
}
FAMILY = {
    "latin": "Adams Allen Álvarez Anderson Baker Bauer Becker Bernard Bertrand Braun Brown Campbell Carter Castillo Castro Clark Collins Cook Cooper David Davies Davis Delgado Díaz Dubois Dupont Durand Edwards Evans Fernández Fischer Fournier Foster Garcia García Girard Gómez González Gray Green Gutiérrez Hall Harris Hartmann Hernández Hill Hoffmann Hughes Jackson Johnson Jones Kelly King Klein Koch Krüger Lambert Lange Lee Lefebvre Leroy Lewis López Martin Martínez Meyer Miller Mitchell Moore Morales Moreau Morel Morgan Morris Müller Murphy Navarro Nelson Neumann Núñez Ortiz Parker Pérez Perrin Peterson Petit Phillips Ramírez Reed Richard Richter Rivera Roberts Robinson Rodríguez Rogers Romero Rousseau Roux Ruiz Sánchez Schäfer Schmidt Schmitz Schneider Schröder Schulz Schwarz Scott Simon Smith Stewart Suárez Taylor Thomas Thompson Torres Turner Vargas Vázquez Vincent Wagner Walker Ward Watson Weber Werner White Williams Wilson Wolf Wood Wright Young Zimmermann".split(),
    "cyrillic": "Алексеенко Бондаренко Васильченко Гончаренко Григоренко Давиденко Демченко Захаренко Иващенко Карпенко Коваленко Кравченко Кузьменко Лысенко Макаренко Марченко Назаренко Остапенко Павленко Петренко Романенко Савченко Сидоренко Тарасенко Тимченко Ткаченко Федоренко Харченко Шевченко Яковенко".split(),
    "han": "王 李 张 刘 陈 杨 黄 赵 周 吴 徐 孙 马 朱 胡 郭 何 高 林 罗 郑 梁 谢 宋 唐 许 韩 冯 邓 曹".split(),
    "hangul": "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권".split(),
    "arabic": "المصري الحسيني الخطيب النجار الحداد السيد الشريف البغدادي التميمي القاسم".split(),
    "hebrew": "כהן לוי מזרחי פרץ ביטון דהן אברהמי פרידמן שפירא רוזן".split(),
    "devanagari": "शर्मा वर्मा गुप्ता सिंह कुमार पटेल यादव मिश्रा जोशी नायर".split(),
    "greek": "Αλεξίου Αναγνώστου Αντωνίου Βασιλείου Γεωργίου Δημητρίου Θεοδώρου Ιωάννου Κωνσταντίνου Μιχαήλ Νικολάου Οικονόμου Παπαδάκη Παπανικολάου Παύλου Πέτρου Σταύρου Στεφάνου Χατζή Χρήστου".split(),
}
TITLES = {
    "m": ["Mr", "MR", "Herr", "Herrn", "HERR", "Monsieur", "M", "Señor", "Sr", "Don", "Г-н", "Господин", "κύριος", "Κύριος", "Sir"],
    "f": ["Mrs", "MRS", "Ms", "Miss", "Frau", "FRAU", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Г-жа", "Госпожа", "κυρία", "Κυρία", "Lady"],
    "": ["Dr", "DR", "Prof", "Professor"],
}
PARTICLES = set("von van der den de del della di da dos du la le al el bin ibn ben abd zu zur ter ten af".split())
_GENDER = {n: g for (_, g), ns in GIVEN.items() for n in ns}
_FAMILY = {n for ns in FAMILY.values() for n in ns}
_LOWER_GIVEN = {n.lower() for n in _GENDER}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_TITLES = "|".join(sorted(map(re.escape, _TITLE), key=len, reverse=True))
_TITLED = rf"(?<!\w)(?P<title>{_TITLES})\.?[ \t]+(?=\w)"
#: A word of a name: letters (marks of scripts that write vowels so included), inner hyphens and apostrophes; or an initial.
_WORD = re.compile(r"(?:[^\W\d_]\.(?=[ \t])|[^\W\d_][^\W\d_\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0640\u064b-\u065f]*(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u064b-\u065f]|['’\-](?=[^\W\d_]))*)")
_GAP = re.compile(r"[ \t\u00a0]{1,2}(?=\w)")
_GIVEN = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
_LISTED = rf"(?<!\w)(?P<both>(?:{_GIVEN})[ \t](?:{'|'.join(sorted(map(re.escape, _FAMILY), key=len, reverse=True))}))(?!\w)"

_PHONE = r"(?:\+\d{1,3}|00[1-9]\d{0,2}(?=[ .\-/]))[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,13}|\(\d{2,4}\)[ .\-]?\d(?:[ .\-/]?\d){5,9}|\d[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|\d{2,4}[ .\-/]\d{3,4}[ .\-/]\d{3,5}|[2-9]\d{2}[2-9]\d{6}"
_SECRET = r"""(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)["']?\s*[:=]\s*["']?"""
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CARD = r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5}"
#: (kind, pattern, what an automaton looks for first: the same without looking around, so it misses nothing).
KINDS: list[tuple[str, re.Pattern, str]] = [
    ("secret", re.compile(rf"(?i){_SECRET}(?P<v>[A-Za-z0-9+/_\-.~]{{8,}}={{0,2}})"), rf"(?i){_SECRET}[A-Za-z0-9+/_\-.~]{{8}}"),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)"), r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ"),
    ("email", re.compile(r"(?<![A-Za-z0-9_%+\-])(?P<v>[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"), r"[A-Za-z0-9_%+\-]@[A-Za-z0-9]"),
    ("ip", re.compile(rf"(?<![\d.])(?P<v>(?:{_OCTET}\.){{3}}{_OCTET})(?!\.?\d)"), r"\d\.\d{1,3}\.\d{1,3}\.\d"),
    ("ip6", re.compile(r"(?<![\w:])(?P<v>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"), r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]"),
    ("iban", re.compile(r"(?<!\w)(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}"),
    ("card", re.compile(rf"(?<![\w.+])(?P<v>{_CARD})(?!\w)"), r"\d{13}|\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}"),
    ("ssn", re.compile(r"(?<![\w\-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w\-])"), r"\d{3}-\d{2}-\d{4}"),
    ("phone", re.compile(rf"(?<![\w.])(?P<v>{_PHONE})(?!\w)"), r"\+\d{1,3}[ .\-(]?\d|00[1-9]\d{0,2}[ .\-/]|\(\d{2,4}\)[ .\-]?\d|\d[ .\-/]\d{3,4}[ .\-/]\d{3}|\d{10}"),
    ("name", re.compile(_TITLED), rf"(?:{_TITLES})\.?[ \t]"),
    ("name", re.compile(_LISTED), rf"(?:{_GIVEN})[ \t]"),
]
#: Country calling codes of one and two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def script_of(word: str) -> str:
    c = ord(word[0])
    for name, spans in (("cyrillic", ((0x400, 0x530),)), ("greek", ((0x370, 0x400), (0x1F00, 0x2000))), ("hebrew", ((0x590, 0x600),)), ("arabic", ((0x600, 0x780),)), ("devanagari", ((0x900, 0x980),)), ("hangul", ((0xAC00, 0xD7B0),)), ("han", ((0x3400, 0xA000), (0x20000, 0x32000)))):
        if any(a <= c < b for a, b in spans):
            return name
    return "latin" if c < 0x370 or 0x1E00 <= c < 0x1F00 else ""


def _titled(text: str, m: re.Match) -> tuple[int, int, str] | None:
    """The whole name after a title: capitalised words, or words of a script without case; particles and initials between them."""
    at, words, end = m.end(), [], 0
    shouted = m["title"].isupper() and len(m["title"]) > 1
    while len(words) < 5 and (w := _WORD.match(text, at)):
        t = w[0]
        script = script_of(t)
        if not script:
            break
        cased = t[0].upper() != t[0].lower()
        if script == "han":
            if words:
                break
            t = t if len(t) <= 4 else t[:3]
            return at, at + len(t), _TITLE[m["title"]]
        if cased and t.lower() in PARTICLES and not (t[0].isupper() and not words):
            pass  # counts if a name follows
        elif not cased or t[0].isupper() and (len(t) == 1 or t[1] in ".'’" or shouted or not t.isupper()):
            end = w.end()
        else:
            break
        words.append(t)
        gap = _GAP.match(text, w.end())
        if not gap:
            break
        at = gap.end()
    words = words[: len(text[m.end() : end].split())] if end else []
    if not words or all(len(w) < 2 or w.endswith(".") for w in words):
        return None
    if m["title"] in ("M", "Don", "Sir", "Lady") and words[0] not in _GENDER and words[0] not in _FAMILY:
        return None  # too short a word to trust before any capital
    return m.end(), end, _TITLE[m["title"]] or _GENDER.get(words[0], "")


def phone_parts(shown: str) -> tuple[str, str, str]:
    """(access prefix, country code, national digits) of a telephone number."""
    d = re.sub(r"\D", "", shown)
    access = ""
    if shown.startswith("00") and len(d) > 10:
        access, d = "00", d[2:]
    elif not shown.startswith("+"):
        return ("", "1", d[1:]) if len(d) == 11 and d[0] == "1" else ("", "", d)
    n = next(k for k in (1, 2, 3) if d[:k] in _CODES or k == 3)
    return access, d[:n], d[n:]


def _form(kind: str, v: str) -> str | None:
    """Canonical form of an entity as it is written; None if it isn't one after all."""
    if kind == "phone":
        _, code, rest = phone_parts(v)
        return f"{code}:{rest.lstrip('0') if code else rest}"
    if kind == "card":
        d = re.sub(r"\D", "", v)
        return d if d != v or (luhn(d) and d[0] in "23456") else None
    if kind == "ssn":
        return v.replace("-", "")
    if kind == "email":
        return v.lower()
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(v).exploded
        except ValueError:
            return None
    if kind == "iban":
        d = v.replace(" ", "")
        return d if sum(c.isdigit() for c in d) >= 8 else None
    if kind == "secret":
        return v if any(c.isdigit() for c in v) or len(v) >= 16 else None
    return v


def entities(text: str, kinds: list[int] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, none overlapping; the form of a name begins with its gender.

    ``kinds``: the numbers of the ``KINDS`` to look for, all by default.
    """
    found: list[tuple[int, int, str, str]] = []
    for number in range(len(KINDS)) if kinds is None else kinds:
        kind, pattern, _ = KINDS[number]
        for m in pattern.finditer(text):
            if kind == "name":
                if "both" in m.groupdict():
                    s, e = m.span("both")
                    gender = _GENDER[re.split(r"[ \t]", m["both"])[0]]
                elif (got := _titled(text, m)) is None:
                    continue
                else:
                    s, e, gender = got
                form = gender + ":" + " ".join(text[s:e].split()).lower()
            else:
                s, e = m.span("v")
                form = _form(kind, text[s:e])
                if form is None:
                    continue
            found.append((s, e, kind, form))
    if len(found) < 2:
        return found
    out, taken = [], []  # the earlier kind, then the longer entity, wins
    for x in found:
        at = bisect.bisect(taken, (x[0], x[1]))
        if (at and taken[at - 1][1] > x[0]) or (at < len(taken) and taken[at][0] < x[1]):
            continue
        taken.insert(at, (x[0], x[1]))
        out.append(x)
    return sorted(out)


class Surrogates:
    """Keyed surrogates; the same key gives the same ones on every machine."""

    def __init__(self, key: bytes):
        self.key = key

    def _bits(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")

    def permuted(self, digits: str, radix: int, tag: str) -> str:
        """A keyed permutation of strings of this length over 0..radix-1 (characters of base 36): a Feistel network on its halves."""
        n = len(digits)
        if n == 1:
            shift = list(range(radix))
            order = sorted(shift, key=lambda v: self._bits(tag, "one", radix, v))
            return "0123456789abcdefghijklmnopqrstuvwxyz"[order[int(digits, 36)]]
        u, v = n // 2, n - n // 2
        a, b = int(digits[:u], radix) if radix <= 36 else 0, int(digits[u:], radix)
        for i in range(8):
            m = u if i % 2 == 0 else v
            a, b = b, (a + self._bits(tag, n, radix, i, b)) % radix**m
        return _spelt(a, radix, u) + _spelt(b, radix, v)

    def walked(self, x: str, radix: int, tag: str, fit) -> str:  # type: ignore[no-untyped-def]
        """The first fit string after ``x`` in its cycle; every permutation leads back to ``x``, so it ends, and is a permutation of the fit ones.

        ``x`` itself if nothing else in the cycle is fit.
        """
        y = self.permuted(x, radix, tag)
        while y != x and not fit(y):
            y = self.permuted(y, radix, tag)
        return y

    def surrogate(self, kind: str, form: str, attempt: int = 0) -> str:
        """Canonical form of the surrogate."""
        x = self.one(kind, form, f"{kind}/{attempt}", attempt)
        # a cycle of one, or a form too short to change: another permutation
        return self.surrogate(kind, form, attempt + 1000) if x == form and attempt < 20_000 else x

    def one(self, kind: str, form: str, tag: str, attempt: int) -> str:
        if kind == "phone":
            code, _, d = form.partition(":")
            zeros = len(d) - len(d.lstrip("0"))
            keep = zeros + 1 if len(d) - zeros > 4 else zeros
            nanp = re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", d) is not None
            return f"{code}:{d[:keep]}" + self.walked(d[keep:], 10, f"{tag}/{code}/{d[:keep]}", lambda y: not nanp or y[2] in "23456789")
        if kind == "ssn":
            issued = lambda y: y[:3] not in ("000", "666") and y[0] != "9" and y[3:5] != "00" and y[5:] != "0000"
            return self.walked(form, 10, tag, lambda y: issued(y) or not issued(form))
        if kind == "card":
            valid = luhn(form)
            return form[0] + self.walked(form[1:], 10, f"{tag}/{form[0]}", lambda y: luhn(form[0] + y) == valid)
        if kind == "ip":
            o = [int(y) for y in form.split(".")]
            h = "".join(f"{y:02x}" for y in o)
            # what says that an address is private, local or reserved stays
            keep = 2 if o[0] in (0, 10, 127) or o[0] >= 224 else 3 if o[0] == 172 and 16 <= o[1] < 32 else 4 if o[:2] in ([192, 168], [169, 254]) else 0
            y = h[:keep] + self.walked(h[keep:], 16, f"{tag}/{h[:keep]}", lambda y: keep > 0 or _public(y))
            return ".".join(str(int(y[k : k + 2], 16)) for k in range(0, 8, 2))
        if kind == "ip6":
            groups = form.split(":")
            keep = 4 if re.match("f|0", groups[0]) or groups[:2] == ["2001", "0db8"] else 1
            more = [k for k in range(1, 8) if groups[k] != "0000" and not (k == 1 and groups[:2] == ["2001", "0db8"])]
            mine = groups[0][keep:] + "".join(groups[k] for k in more)
            tail = len(mine) - 4 * len(more)
            split = lambda y: [y[tail + 4 * k : tail + 4 * k + 4] for k in range(len(more))]
            y = self.walked(mine, 16, f"{tag}/{more}/{groups[0][:keep]}", lambda y: "0000" not in split(y)) if mine else ""
            groups[0] = groups[0][:keep] + y[:tail]
            for k, g in zip(more, split(y)):
                groups[k] = g
            return ":".join(groups)
        if kind == "iban":
            if not _mod97(form):
                return form[:2] + self.classes(form[2:], tag)
            rest = self.classes(form[4:], f"{tag}/{form[:2]}")
            return f"{form[:2]}{98 - int(_iban_digits(rest + form[:2] + '00')) % 97:02d}{rest}"
        if kind == "email":
            local, _, domain = form.rpartition("@")
            # the domain goes to one of the reserved kind; the whole address is in the local part's permutation
            return f"{self.classes(local, tag + '/' + domain)}@{self.classes(domain.rpartition('.')[0], tag)}.{'example' if domain.endswith('.example') else 'invalid'}"
        if kind == "name":
            return self.person(form, attempt)
        return self.classes(form, tag)

    def classes(self, s: str, tag: str) -> str:
        """Digits permuted as one number, letters as one word in base 26, everything else in its place."""
        if s and all(c in "0123456789abcdef" for c in s) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(s) > 8:
            return self.permuted(s, 16, tag)  # hexadecimal stays hexadecimal
        d = "".join(c for c in s if "0" <= c <= "9")
        w = "".join(c.lower() for c in s if c.isascii() and c.isalpha())
        case = "".join("A" if c.isupper() else "a" for c in s if c.isascii() and c.isalpha())
        # each part's permutation is keyed by what the other leaves alone, so the whole stays a permutation
        d2 = self.permuted(d, 10, f"{tag}/d/{case}") if d else ""
        w2 = _letters(self.permuted(_numbers(w), 26, f"{tag}/w/{case}/{d}")) if w else ""
        di, wi = iter(d2), iter(w2)
        return "".join(next(di) if "0" <= c <= "9" else (lambda x: x.upper() if c.isupper() else x)(next(wi)) if c.isascii() and c.isalpha() else c for c in s)

    def person(self, form: str, attempt: int) -> str:
        gender, _, name = form.partition(":")
        parts = name.split(" ")
        script = script_of(parts[0])
        if script == "han":
            return self.han(gender, name, attempt)
        changed = [k for k, p in enumerate(parts) if p not in PARTICLES]
        # titles say whose family name follows; what stands before it is given
        last = changed[-1] if len(changed) > 1 or parts[changed[0]] not in _LOWER_GIVEN else -1
        vary = changed[(attempt - 1) % len(changed)] if attempt else -1
        out = []
        for k, p in enumerate(parts):
            if k not in changed:
                out.append(p)
            elif p.endswith("."):
                letters = _alphabet(script).lower().replace(p[0], "")
                out.append(letters[self._bits("initial", p, attempt if k == vary else 0) % len(letters)] + ".")
            else:
                out.append("-".join(q if q in PARTICLES else self.part(q, script, gender, k != last, form if k == vary else "", attempt) for q in p.split("-")))
        if attempt > 8:  # the list is exhausted: initials tell them apart
            n, letters = self._bits("initials", form, attempt), _alphabet(script)
            out.insert(len(out) - (len(out) > 1), ".".join(letters[(n >> (5 * k)) % len(letters)] for k in range(min(6, attempt // 8))).lower() + ".")
        return gender + ":" + " ".join(out)

    def part(self, p: str, script: str, gender: str, given: bool, form: str, attempt: int) -> str:
        """Another name for one; a family name has one surrogate in all names that it is part of, so relatives stay relatives."""
        pool = (GIVEN[script, gender] if gender else GIVEN[script, "f"] + GIVEN[script, "m"]) if given else FAMILY[script]
        n = self._bits("name", script, gender if given else "", p)
        if form:
            n += self._bits("again", form, attempt)
        n %= len(pool)
        return (pool[n] if pool[n].lower() != p else pool[(n + 1) % len(pool)]).lower()

    def han(self, gender: str, name: str, attempt: int) -> str:
        """A name of as many characters: the family name first."""
        family = self.part(name[0], "han", gender, False, name if attempt and attempt % 2 == 0 else "", attempt)
        pool = GIVEN["han", gender] if gender else GIVEN["han", "f"] + GIVEN["han", "m"]
        letters = sorted({c for g in pool for c in g})
        n = self._bits("han", gender, name[1:], attempt)
        rest = ""
        while len(rest) < len(name) - 1:
            fit = [g for g in pool if len(g) <= len(name) - 1 - len(rest)] if not rest and len(name) < 4 else letters
            fit = [g for g in fit if len(g) == len(name) - 1] or letters
            rest, n = rest + fit[n % len(fit)], n // len(fit) + self._bits("more", n)
        return f"{gender}:{family}{rest[: len(name) - 1]}"

    def written(self, kind: str, shown: str, form: str, surrogate: str) -> str:
        """The surrogate in the format of the entity as it is shown."""
        if kind in ("phone", "card", "ssn"):
            digits = surrogate
            if kind == "phone":
                access, code, rest = phone_parts(shown)
                new = surrogate.partition(":")[2]
                digits = access + code + rest[: len(rest) - len(new)] + new
            d = iter(digits)
            return "".join(next(d) if c.isdigit() else c for c in shown)
        if kind == "iban":
            c = iter(surrogate)
            return "".join(" " if x == " " else next(c) for x in shown)
        if kind == "ip6":
            groups = surrogate.split(":")
            short = [g.lstrip("0") or "0" for g in groups]
            if "::" in shown:  # zeros are where they were
                before, after = shown.split("::")
                n, m = len(before.split(":")) if before else 0, len(after.split(":")) if after else 0
                out = ":".join(short[:n]) + "::" + ":".join(short[8 - m :] if m else [])
            else:
                out = ":".join(g if len(x) == 4 else y for g, x, y in zip(groups, shown.split(":"), short))
            return out.upper() if any(c.isupper() for c in shown) else out
        if kind == "name":
            gaps, old = re.findall(r"\s+", shown), shown.split()
            words = surrogate.partition(":")[2].split(" ")
            same = len(words) == len(old)
            loud = all(w.isupper() for w in old if w[0].upper() != w[0].lower() and len(w) > 2) and any(len(w) > 2 and w.isupper() for w in old)
            for k, w in enumerate(words):
                if loud or w.endswith("."):
                    words[k] = w.upper()
                elif w not in PARTICLES or same and old[k][0].isupper():
                    words[k] = "-".join(p[:1].upper() + p[1:] for p in w.split("-"))
            gaps = gaps if same else [gaps[0] if gaps else " "] * (len(words) - 1)
            return "".join(w + g for w, g in zip(words, [*gaps, ""]))
        if kind == "email" and shown.isupper():
            return surrogate.upper()
        return surrogate


def _public(h: str) -> bool:
    """Whether eight hexadecimal digits are a public IPv4 address."""
    o = [int(h[k : k + 2], 16) for k in range(0, 8, 2)]
    return 0 < o[0] < 224 and o[0] not in (10, 127) and not (o[0] == 172 and 16 <= o[1] < 32) and o[:2] not in ([192, 168], [169, 254])


def _alphabet(script: str) -> str:
    return {"cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "devanagari": "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", "hangul": "가나다라마바사아자차카타파하"}.get(script, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _iban_digits(s: str) -> str:
    return "".join(c if c.isdigit() else str(ord(c) - 55) for c in s)


def _mod97(iban: str) -> bool:
    return int(_iban_digits(iban[4:] + iban[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _spelt(n: int, radix: int, width: int) -> str:
    out = []
    for _ in range(width):
        n, r = divmod(n, radix)
        out.append("0123456789abcdefghijklmnopqrstuvwxyz"[r])
    return "".join(reversed(out))


_TO26 = str.maketrans("abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop")
_FROM26 = str.maketrans("0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz")


def _numbers(w: str) -> str:
    return w.translate(_TO26)


def _letters(w: str) -> str:
    return w.translate(_FROM26)


def _likely(texts: pa.Array) -> list[tuple[int, list[int]]]:
    """(row, kinds that it may have) of the texts that may have any."""
    hit = np.stack([pc.fill_null(pc.match_substring_regex(texts, hint), False).to_numpy(zero_copy_only=False) for _, _, hint in KINDS], 1)
    return [(int(i), np.flatnonzero(hit[i]).tolist()) for i in np.flatnonzero(hit.any(1))]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = {(k, f) for i, kinds in _likely(b.column(0)) for _, _, k, f in entities(b.column(0)[i].as_py(), kinds)}
        if found:
            k, f = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f)], ["kind", "form"])


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for b in batches:
            k, f, a = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s.surrogate(*x) for x in zip(k, f, a)], pa.string())], ["kind", "form", "attempt", "surrogate"])

    return run


def attempts(docs: DataFrame, key: bytes, text: str = "text", rounds: int = 40) -> DataFrame:
    """(kind, form, attempt, surrogate) of every distinct entity, no surrogate being shared or itself an entity."""
    found = cut(docs.select(column(docs, text).alias("t")).where("t is not null").mapInArrow(_collect, "kind string, form string").distinct())
    schema = "kind string, form string, attempt int, surrogate string"
    todo = found.select("kind", "form", F.lit(0).alias("attempt"))
    settled = None
    for _ in range(rounds):
        tried = todo.mapInArrow(_surrogates(key), schema)
        real = found.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
        # names are compared without their gender, as a reader sees them
        seen = lambda c: F.regexp_replace(c, "^[mf]?:", "")
        tried = tried.withColumn("shown", F.when(F.col("kind") == "name", seen("surrogate")).otherwise(F.col("surrogate")))
        real = real.select("kind", F.when(F.col("kind") == "name", seen("surrogate")).otherwise(F.col("surrogate")).alias("shown"), "real").distinct()
        taken = real if settled is None else real.union(settled.select("kind", F.when(F.col("kind") == "name", seen("surrogate")).otherwise(F.col("surrogate")).alias("shown"), F.lit(True))).distinct()
        least = tried.groupBy("kind", "shown").agg(F.min("form").alias("least"))
        judged = cut(tried.join(least, ["kind", "shown"]).join(taken, ["kind", "shown"], "left").select("kind", "form", "attempt", "surrogate", (F.col("real").isNull() & (F.col("form") == F.col("least"))).alias("good")))
        good = judged.where("good").drop("good")
        settled = good if settled is None else settled.union(good)
        todo = judged.where("not good").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return settled
    raise RuntimeError("surrogates did not become distinct")


def replaced(text: str | None, s: Surrogates, exceptions: dict[tuple[str, str], int], kinds: list[int] | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it has."""
    if not text:
        return text, 0
    found = entities(text, kinds)
    if not found:
        return text, 0
    out, at = [], 0
    for b, e, k, f in found:
        out += [text[at:b], s.written(k, text[b:e], f, s.surrogate(k, f, exceptions.get((k, f), 0)))]
        at = e
    return "".join([*out, text[at:]]), len(found)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", broadcast_exceptions: int = 100_000) -> DataFrame:
    """``docs`` with surrogates in ``text`` and their number in ``n_entities``; see the module."""
    d = docs.select(*[column(docs, c) for c in docs.columns if c != "n_entities"])
    at = d.columns.index(text)
    added = [T.StructField("n_entities", T.IntegerType())]
    other = attempts(docs, key, text).where("attempt > 0").select("kind", "form", "attempt")
    few = other.limit(broadcast_exceptions + 1).collect()
    if len(few) <= broadcast_exceptions:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in few})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Surrogates(key)
            for b in batches:
                yield _rewritten(b, at, lambda i, t, kinds: replaced(t, s, shared.value, kinds))

        return extended(d, run, added)

    # too many to hold in every executor: each text gets its own, by a join on its entities
    row, tries_ = fresh(d, "__row"), fresh(d, "__tries")
    keyed = cut(d.withColumn(row, F.monotonically_increasing_id()))
    asked = keyed.select(F.col(row).alias("row"), column(keyed, text).alias("t")).where("t is not null").mapInArrow(_by_row, "row bigint, kind string, form string")
    mine = asked.join(other, ["kind", "form"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(tries_))
    names = d.columns
    both = keyed.join(mine, row, "left").select(*[quoted(c) for c in names], tries_)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for b in batches:
            tries = b.column(len(names))
            yield _rewritten(b, at, lambda i, t, kinds: replaced(t, s, {(x["kind"], x["form"]): x["attempt"] for x in tries[i].as_py() or []}, kinds))  # noqa: B023

    return extended(both, run_joined, added).drop(tries_)


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(b.column(0)[i].as_py(), k, f) for i, kinds in _likely(b.column(1)) for k, f in {x[2:] for x in entities(b.column(1)[i].as_py(), kinds)}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["row", "kind", "form"])


def _rewritten(b: pa.RecordBatch, at: int, change) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
    texts = b.column(at)
    n = np.zeros(b.num_rows, np.int32)
    new: dict[int, str] = {}
    for i, kinds in _likely(texts):
        t, n[i] = change(i, texts[i].as_py(), kinds)
        if n[i]:
            new[i] = t
    if new:
        # everything else is copied as it stands
        mask = np.zeros(b.num_rows, bool)
        mask[list(new)] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
    return pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)] + [pa.array(n)], [*b.schema.names, "n_entities"])
