"""Missing or wrong document language labels (problem 3).

Method: compression classification. Every language has a zstandard raw-content dictionary. A segment (sentence or clause) is encoded
with each dictionary and belongs to the language whose dictionary gives the smallest result; when the runner-up is nearly as
small the segment is rejected and counts for no language. The dictionaries begin with a paragraph of each language written for this
module and are completed by a bounded sample of the corpus: segments of records declared to be in that language for which the first
dictionaries agree with the declaration, so wrong declarations do not teach. Everything is compared in one spelling: width,
invisible characters, look-alike letters, accents and Cyrillic script are normalised, so that spelling does not change the language.
Of the languages here only one is written with Japanese syllables and only one with Cyrillic letters, so script leaves one candidate for
such segments; romanised Russian is classified by its encoding like the rest.

Defined cases: a null or empty field and one with single words, names, links, numbers, emoji or marks only has no language; a long text is
read whole; of several rows of one record the longest text of each field counts and any known declaration; an
empty table gives an empty result; a null id takes no part; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawright.llm.scrub import plain, romanised, unaccented
from stratawright.session import cut, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "tr", "ru", "ja")
#: Declared records taken per language to complete its dictionary, the groups in which they are ranked, and the most bytes of a dictionary.
SAMPLE, GROUPS, DICTIONARY_BYTES = 1000, 64, 60_000
#: Least share by which the smallest encoding must undercut the next, and least letters of a segment.
MARGIN, LEAST_LETTERS, LEAST_WORDS = 0.06, 12, 3
#: Short matches must count, or short segments are stored as they are and all encodings have one size.
SEARCH = {"window_log": 17, "chain_log": 14, "hash_log": 14, "search_log": 4, "min_match": 4, "target_length": 64, "strategy": zstandard.STRATEGY_DFAST}
#: Rounds in which the dictionaries judge the declared sample anew, and the margin that it needs.
ROUNDS, TEACHES = 3, 0.06
#: Confidence and letters that a further language of a field needs, in one of its segments or over all: names alone can look foreign.
SURE, SURE_LETTERS = 0.97, 18
#: Segments whose languages a Python worker remembers; equal segments are encoded once.
REMEMBERED = 200_000

#: What declarations mean, besides a code with or without region.
DECLARED = {
    "en": "eng english anglais englisch", "de": "ger deu german deutsch allemand", "fr": "fre fra french francais französisch",
    "es": "spa spanish espanol español castellano spanisch", "pt": "por portuguese portugues português", "it": "ita italian italiano",
    "nl": "dut nld dutch nederlands", "pl": "pol polish polski", "tr": "tur turkish turkce türkçe", "ru": "rus russian русский", "ja": "jpn japanese 日本語",
}
#: Declarations that say nothing.
UNKNOWN = ("", "und", "unknown", "unk", "n/a", "na", "none", "null", "?", "-", "xx", "zxx", "mul", "mis", "other", "auto")

#: A paragraph of each language, written for this module: everyday words, so that every dictionary begins with common forms.
SEEDS = {
    "en": "I have been trying to find out what is wrong with it for some weeks now, and nobody here could tell me why it does not work any more. The man at the shop says that I should buy a new one, but my sister thinks we can still repair this ourselves. Has anyone had the same trouble before? Thanks a lot for your help, I will write again when I know more about it. When it was raining last night there were two of them in the kitchen, and then they went away with their friends. You would have to check the other side first, because most people forget about that. Is it worth the money? What should we do next? Please let me know which one you like best and where you got it from. There is no reason to think that she could not come earlier than this, although he never said so. Everybody knows how these things are made, don't they?",
    "de": "Ich versuche seit einigen Wochen herauszufinden, was damit nicht stimmt, und niemand konnte mir sagen, warum es nicht mehr funktioniert. Der Mann im Laden meint, dass ich einen neuen kaufen soll, aber meine Schwester denkt, wir können das noch selbst reparieren. Hatte jemand schon einmal das gleiche Problem? Vielen Dank für eure Hilfe, ich schreibe wieder, wenn ich mehr darüber weiß. Als es gestern Abend geregnet hat, waren zwei davon in der Küche, und dann sind sie mit ihren Freunden weggegangen. Man müsste zuerst die andere Seite prüfen, weil die meisten Leute das vergessen. Lohnt sich das für das Geld? Was sollen wir als Nächstes tun? Bitte sagt mir, welche euch am besten gefällt und woher ihr sie habt. Es gibt keinen Grund zu glauben, dass sie nicht früher kommen könnte, obwohl er es nie gesagt hat.",
    "fr": "J'essaie depuis quelques semaines de comprendre ce qui ne va pas avec ça, et personne ici n'a pu me dire pourquoi cela ne marche plus. Le monsieur du magasin dit que je devrais en acheter un neuf, mais ma sœur pense que nous pouvons encore le réparer nous-mêmes. Est-ce que quelqu'un a déjà eu le même problème? Merci beaucoup pour votre aide, je vous écrirai quand j'en saurai plus. Quand il pleuvait hier soir, il y en avait deux dans la cuisine, et puis elles sont parties avec leurs amis. Il faudrait d'abord vérifier l'autre côté, parce que la plupart des gens l'oublient. Est-ce que ça vaut le prix? Que devons-nous faire maintenant? Dites-moi lequel vous plaît le plus et où vous l'avez trouvé. Il n'y a aucune raison de croire qu'elle ne pourrait pas venir plus tôt, bien qu'il ne l'ait jamais dit.",
    "es": "Llevo unas semanas intentando averiguar qué le pasa a esto, y nadie de aquí ha podido decirme por qué ya no funciona. El hombre de la tienda dice que debería comprar uno nuevo, pero mi hermana cree que todavía podemos arreglarlo nosotros mismos. ¿Alguien ha tenido antes el mismo problema? Muchas gracias por vuestra ayuda, escribiré otra vez cuando sepa más. Cuando llovía anoche había dos en la cocina, y luego se fueron con sus amigos. Habría que mirar primero el otro lado, porque la mayoría de la gente se olvida de eso. ¿Merece la pena por ese dinero? ¿Qué debemos hacer ahora? Por favor, decidme cuál os gusta más y de dónde lo habéis sacado. No hay ninguna razón para pensar que ella no pudiera venir antes, aunque él nunca lo dijo.",
    "pt": "Estou há algumas semanas tentando descobrir o que há de errado com isso, e ninguém aqui conseguiu me dizer por que não funciona mais. O homem da loja diz que eu deveria comprar um novo, mas minha irmã acha que ainda podemos consertar isso nós mesmos. Alguém já teve o mesmo problema antes? Muito obrigado pela ajuda de vocês, vou escrever de novo quando souber mais. Quando chovia ontem à noite havia dois na cozinha, e depois eles foram embora com os seus amigos. Seria preciso olhar primeiro o outro lado, porque a maioria das pessoas se esquece disso. Vale o dinheiro? O que devemos fazer agora? Por favor, digam qual vocês acham melhor e onde compraram. Não há nenhuma razão para pensar que ela não poderia vir mais cedo, embora ele nunca tenha dito isso.",
    "it": "Sono alcune settimane che cerco di capire che cosa non va, e nessuno qui ha saputo dirmi perché non funziona più. L'uomo del negozio dice che dovrei comprarne uno nuovo, ma mia sorella pensa che possiamo ancora aggiustarlo da soli. Qualcuno ha già avuto lo stesso problema? Grazie mille per il vostro aiuto, scriverò di nuovo quando ne saprò di più. Quando ieri sera pioveva ce n'erano due in cucina, e poi sono andati via con i loro amici. Bisognerebbe guardare prima l'altro lato, perché la maggior parte della gente se ne dimentica. Vale quei soldi? Che cosa dobbiamo fare adesso? Per favore ditemi quale vi piace di più e dove l'avete preso. Non c'è nessun motivo di credere che lei non potesse venire prima, anche se lui non l'ha mai detto.",
    "nl": "Ik probeer al een paar weken uit te zoeken wat er mis mee is, en niemand hier kon mij vertellen waarom het niet meer werkt. De man van de winkel zegt dat ik een nieuwe moet kopen, maar mijn zus denkt dat we het nog zelf kunnen repareren. Heeft iemand eerder hetzelfde probleem gehad? Heel erg bedankt voor jullie hulp, ik schrijf weer als ik er meer over weet. Toen het gisteravond regende waren er twee in de keuken, en daarna zijn ze met hun vrienden weggegaan. Je zou eerst de andere kant moeten bekijken, omdat de meeste mensen dat vergeten. Is het dat geld waard? Wat moeten we nu doen? Laat me weten welke je het mooist vindt en waar je die vandaan hebt. Er is geen reden om te denken dat zij niet eerder kon komen, hoewel hij dat nooit gezegd heeft.",
    "pl": "Od kilku tygodni próbuję dowiedzieć się, co jest z tym nie tak, i nikt tutaj nie umiał mi powiedzieć, dlaczego to już nie działa. Pan ze sklepu mówi, że powinienem kupić nowy, ale moja siostra uważa, że jeszcze możemy to naprawić sami. Czy ktoś miał już wcześniej taki sam problem? Bardzo dziękuję za waszą pomoc, napiszę znowu, kiedy będę wiedział więcej. Kiedy wczoraj wieczorem padał deszcz, były dwa w kuchni, a potem poszły ze swoimi przyjaciółmi. Trzeba by najpierw sprawdzić drugą stronę, ponieważ większość ludzi o tym zapomina. Czy to jest warte tych pieniędzy? Co mamy teraz zrobić? Proszę, napiszcie, który wam się najbardziej podoba i skąd go macie. Nie ma żadnego powodu, żeby myśleć, że ona nie mogła przyjść wcześniej, chociaż on nigdy tego nie powiedział.",
    "tr": "Birkaç haftadır bunun nesi olduğunu anlamaya çalışıyorum ve burada kimse bana neden artık çalışmadığını söyleyemedi. Dükkândaki adam yeni bir tane almam gerektiğini söylüyor, ama kız kardeşim bunu hâlâ kendimiz onarabileceğimizi düşünüyor. Daha önce aynı sorunu yaşayan oldu mu? Yardımınız için çok teşekkür ederim, daha fazla öğrenince tekrar yazacağım. Dün akşam yağmur yağarken mutfakta iki tane vardı, sonra arkadaşlarıyla birlikte gittiler. Önce öbür tarafa bakmak gerekir, çünkü insanların çoğu bunu unutuyor. Bu paraya değer mi? Şimdi ne yapmalıyız? Lütfen hangisini daha çok beğendiğinizi ve nereden aldığınızı yazın. Onun daha erken gelemeyeceğini düşünmek için hiçbir neden yok, oysa o bunu hiç söylemedi.",
    "ru": "Уже несколько недель пытаюсь выяснить, что с этим не так, и никто здесь не смог мне сказать, почему оно больше не работает. Человек в магазине говорит, что мне надо купить новый, но моя сестра думает, что мы ещё можем починить это сами. У кого-нибудь раньше была такая же проблема? Большое спасибо за вашу помощь, напишу снова, когда буду знать больше. Когда вчера вечером шёл дождь, на кухне их было двое, а потом они ушли со своими друзьями. Сначала надо было бы проверить другую сторону, потому что большинство людей об этом забывает. Стоит ли это таких денег? Что нам теперь делать? Пожалуйста, напишите, какой вам больше нравится и где вы его взяли. Нет никакой причины думать, что она не могла прийти раньше, хотя он никогда этого не говорил.",
}

CYRILLIC = re.compile(r"[Ѐ-ӿ]")
JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
KANA = re.compile(r"[぀-ヿ]")
NOISE = re.compile(r"https?://\S+|www\.\S+|\S+ ?@ ?\S+|\S*[(\[]at[)\]]\S*|[@#/]\w+(?:[/_]\w+)*|\[\w+\]|\bu/\w+|\br/\w+", re.IGNORECASE)
#: Sentences end at their sign before a blank, at a line end, at a bar or a slash between blanks, or at a Japanese stop.
ENDS = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\s*[\r\n]+\s*|\s+[|/]\s+|(?<=[。！？])")
#: The first of these ends, for texts without a sign of the others.
SIGNED = re.compile(r"[.!?…][\"'»”)\]]*\s+")
WORDS = re.compile(r"[^\W\d_]+")
QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{1,40}[\"”“»]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: ASCII in small letters, all else as blanks.
ASCII_LETTERS = "".join(chr(i).lower() if chr(i).isalpha() else " " for i in range(128))


def folded(segment: str) -> str:
    """Letters of a segment in one spelling, words divided by one blank."""
    if segment.isascii():
        return " ".join(segment.translate(ASCII_LETTERS).split())
    return NOT_LETTERS.sub(" ", unaccented(romanised(segment.casefold()))).strip()


class Classifier:
    """Smallest encoding over one dictionary per language."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = [x for x in LANGUAGES if x in texts]
        self.coders = []
        for name in self.languages:
            settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
            content = zstandard.ZstdCompressionDict(texts[name][-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))
        self.memory: dict[str, tuple[str, float]] = {}

    def score(self, letters: str) -> tuple[str, float]:
        """Language and margin of a folded segment; equal ones are encoded once."""
        known = self.memory.get(letters)
        if known is None:
            data = letters.encode()
            sizes = [len(coder.compress(data)) for coder in self.coders]
            best, second = sorted(sizes)[:2]
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            known = self.memory[letters] = self.languages[sizes.index(best)], (second - best) / max(1, second)
        return known

    def learn(self, many: Iterable[str]) -> None:
        """Remember the scores of folded segments, encoded together in one call per dictionary; the sizes are those of single calls."""
        wanted = dict.fromkeys(many)
        new = [x for x in wanted if x not in self.memory]
        if not new:
            return
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(wanted)
        data = [x.encode() for x in new]
        sizes = np.empty((len(self.coders), len(new)), np.int64)
        for row, coder in zip(sizes, self.coders, strict=True):
            row[:] = [len(x) for x in coder.multi_compress_to_buffer(data, threads=1)]
        best, second = np.partition(sizes, 1, axis=0)[:2]
        names = map(self.languages.__getitem__, sizes.argmin(axis=0).tolist())
        self.memory.update(zip(new, zip(names, ((second - best) / np.maximum(1, second)).tolist(), strict=True), strict=True))

    def judged(self, told: str, letters: str) -> tuple[str | None, float]:
        """Language or None, and a confidence in [0, 1], of what ``legible`` gives."""
        if told or not letters:
            return told or None, 1.0 if told else 0.0
        name, margin = self.score(letters)
        return (name if margin >= MARGIN else None), min(1.0, margin / (2 * MARGIN))

    def segment(self, segment: str) -> tuple[str | None, float]:
        """Language or None, and a confidence in [0, 1]."""
        return self.judged(*legible(segment))

    def field(self, text: str | None) -> list[tuple[str, str, float]]:
        """(segment, language or "", confidence) of every segment of a field."""
        return self._field([(s, *legible(s)) for s in segments(text)])

    def fields(self, texts: Iterable[str | None]) -> list[list[tuple[str, str, float]]]:
        """The same for many fields, whose segments are encoded together."""
        read = [[(s, *legible(s)) for s in segments(text)] for text in texts]
        self.learn(letters for parts in read for _, _, letters in parts if letters)
        return [self._field(parts) for parts in read]

    def _field(self, parts: list[tuple[str, str, str]]) -> list[tuple[str, str, float]]:
        found = [(s, name or "", sure) for s, told, letters in parts for name, sure in [self.judged(told, letters)]]
        doubtful = [s for s, name, _ in found if not name and (s.isascii() or not JAPANESE.search(s))]
        if doubtful:  # what is too short to tell alone may be told together, unless the field's languages account for it
            letters = " ".join(map(folded, doubtful))
            if letters.count(" ") + 1 >= LEAST_WORDS and len(letters) >= 2 * LEAST_LETTERS:
                name, margin = self.score(letters)
                if margin >= MARGIN / 2 and (len(doubtful) == len(found) or len(letters) >= 40 and margin >= MARGIN):
                    found = [(s, n or (name if len(folded(s)) >= LEAST_LETTERS else ""), sure if n else min(1.0, margin / (2 * MARGIN))) for s, n, sure in found]
        return found


def legible(segment: str) -> tuple[str, str]:
    """Language that a segment's script tells, or else its folded letters, if they are enough to be encoded."""
    if not segment.isascii():
        japanese = len(JAPANESE.findall(segment))
        if japanese:
            latin = sum(len(w) for w in WORDS.findall(segment) if not JAPANESE.search(w))
            if KANA.search(segment) and japanese >= 6 and japanese * 2 > latin:
                return "ja", ""
            segment = JAPANESE.sub(" ", segment)
        cyrillic = len(CYRILLIC.findall(segment))
        if cyrillic >= LEAST_LETTERS and cyrillic * 2 > sum(map(len, WORDS.findall(segment))) and len(WORDS.findall(segment)) >= LEAST_WORDS:
            return "ru", ""
        letters = folded(segment)
    else:
        letters = " ".join(segment.translate(ASCII_LETTERS).split())
    blanks = letters.count(" ")
    return "", "" if blanks + 1 < LEAST_WORDS or len(letters) - blanks < LEAST_LETTERS else letters


def ended(text: str) -> list[str]:
    """A text split at ENDS."""
    if "\n" in text or "\r" in text or "/" in text or "|" in text or not text.isascii() and ("。" in text or "！" in text or "？" in text):
        return ENDS.split(text)
    parts, at = [], 0
    for m in SIGNED.finditer(text):
        parts.append(text[at : m.start() + 1])
        at = m.end()
    parts.append(text[at:])
    return parts


def segments(text: str | None) -> list[str]:
    """Sentences and clauses of a text without quoted words, links and marks."""
    if not text:
        return []
    text = plain(text)
    if "@" in text or "/" in text or "(at" in text or "[" in text or "#" in text or "www." in text:
        text = NOISE.sub(" ", text)
    if '"' in text or "“" in text or "«" in text or "„" in text:
        text = QUOTED.sub(" ", text)
    return [s for s in ended(text) if s and not s.isspace()]


# --- records and declarations --------------------------------------------------------------------------------------------


def record_fields(posts: DataFrame, communities: DataFrame) -> DataFrame:
    """record_kind, record_id, field, text: one row per field of every row; copies of a record stay, so that all their texts are read."""

    def fields(df: DataFrame, kind: str, key: str, names: list[str]) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_id"), *names)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names]))
        return spread(rows).select(F.lit(kind).alias("record_kind"), "record_id", each.alias("f")).select("record_kind", "record_id", "f.field", "f.text")

    return fields(posts, "post", "post_id", ["title", "selftext"]).unionByName(fields(communities, "community", "community_id", ["public_description"]))


def declared_code(column: str) -> Column:
    """Code of a declaration, "?" for a value that names none of the languages here, null for one that says nothing."""
    value = F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))
    head = F.regexp_extract(value, r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    names = {n: code for code, words in DECLARED.items() for n in [code, *words.split()]}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    code = F.coalesce(F.try_element_at(table, value), F.try_element_at(table, head))
    return F.when(value.isNull() | value.isin(*UNKNOWN), None).otherwise(F.coalesce(code, F.lit("?")))


def code_bit(column: str) -> Column:
    """A bit for each language, and one for "?"."""
    codes = (*LANGUAGES, "?")
    place = F.array_position(F.array(*map(F.lit, codes)), F.col(column)).cast("int")
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(len(codes))]), place)


def declarations(declared_langs: DataFrame) -> DataFrame:
    """record_kind, record_id, declared (bits of codes): one row per record that has a known declaration."""
    rows = declared_langs.select(F.lower(F.trim("record_kind")).alias("record_kind"), F.col("record_id").cast("string").alias("record_id"), declared_code("lang").alias("code"))
    return rows.filter("record_id is not null and code is not null").groupBy("record_kind", "record_id").agg(F.bit_or(code_bit("code")).alias("declared"))


# --- training ----------------------------------------------------------------------------------------------------------------


def seed_texts() -> dict[str, bytes]:
    return {name: " ".join(folded(s) for s in segments(text)).encode() for name, text in SEEDS.items()}


def train(spark: SparkSession, posts: DataFrame, declared_langs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionary of every language: its paragraph, preceded by a sample of at most ``sample`` records per language.

    The sample is the declared records with the smallest hash of their id, so it is bounded and the same on every run.
    """
    declared = declared_langs.filter(F.lower(F.trim("record_kind")) == "post").select("record_id", declared_code("lang").alias("code")).filter(F.col("code").isin(*LANGUAGES[:-1]))
    ranked = declared.distinct().withColumn("order", F.xxhash64("record_id"))
    # Smallest hashes in groups first, so the declarations of a frequent language never meet in one task, whatever ``sample`` is.
    part = Window.partitionBy("code", F.pmod("order", F.lit(GROUPS))).orderBy("order", "record_id")
    few = ranked.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= sample)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("order", "record_id"))).filter(F.col("n") <= sample).select("record_id", "code", "order")
    rows = posts.select(F.col("post_id").alias("record_id"), "title", "selftext").join(F.broadcast(few), "record_id").groupBy("record_id", "code", "order").agg(F.max("title").alias("title"), F.max("selftext").alias("selftext")).collect()
    told: dict[str, list[list[str]]] = {name: [] for name in SEEDS}
    for row in sorted(rows, key=lambda r: (r.code, r.order, r.record_id)):
        letters = [x for text in (row.title, row.selftext) for x in map(folded, segments(text)) if x.count(" ") >= 3]
        if letters:
            told[row.code].append(letters)
    return grow(told)


def within(parts: Iterable[str], most: int) -> bytes:
    """The first of the parts, whole and divided by blanks, that fit into so many bytes."""
    kept, size = [], 0
    for part in parts:
        data = part.encode()
        if size + len(data) <= most:
            kept.append(data)
            size += len(data) + 1
    return b" ".join(kept)


def grow(told: dict[str, list[list[str]]]) -> dict[str, bytes]:
    """Dictionaries from the paragraphs and, in ROUNDS rounds, from the declared records that they agree with.

    ``told`` has the folded segments of each record by declared language, in order of the hash of its id, so what fits into a dictionary is a sample
    of what was taken, too. A record teaches when most of its letters are in its
    declared language, and then those of its segments that are; a wrong declaration or a foreign passage teaches nothing.
    """
    seeds = seed_texts()
    texts = seeds
    for _ in range(ROUNDS):
        model = Classifier(texts)
        model.learn(x for records in told.values() for letters in records for x in letters)
        content = {}
        for name, records in told.items():
            taken: dict[str, None] = {}
            for letters in records:
                scored = [(x, *model.score(x)) for x in letters]
                mine = [x for x, found, margin in scored if found == name and margin >= TEACHES]
                other = sum(len(x) for x, found, margin in scored if found != name and margin >= TEACHES)
                if sum(map(len, mine)) > other:
                    taken.update(dict.fromkeys(mine))
            content[name] = within(taken, DICTIONARY_BYTES - len(seeds[name]) - 1)
        texts = {name: content.get(name, b"") + b" " + seed for name, seed in seeds.items()}
    return texts


# --- operator ----------------------------------------------------------------------------------------------------------------

_LOADED: dict[int, Classifier] = {}


def _classifier(texts: dict[str, bytes]) -> Classifier:
    key = hash(tuple(sorted(texts.items())))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Classifier(texts)
    return _LOADED[key]


def merge(found: Iterable[tuple[str, str, float]]) -> list[tuple[str, int, float]]:
    """(language, characters, confidence) of a field; the confidence is the mean over its segments by their letters."""
    found = list(found)
    if len(found) == 1:
        ((segment, name, sure),) = found
        n = len(segment)
        return [(name, n, n * sure / n)] if name else []
    if len({name for _, name, _ in found}) == 1:  # most fields have one language
        n = sum([len(segment) for segment, _, _ in found])
        return [(found[0][1], n, sum([len(s) * sure for s, _, sure in found]) / n)] if found[0][1] else []
    letters: dict[str, int] = {}
    weight: dict[str, float] = {}
    certain = {name for segment, name, sure in found if name and sure >= SURE and len(segment) >= SURE_LETTERS}
    for segment, name, sure in found:
        if name:
            n = len(segment)
            letters[name] = letters.get(name, 0) + n
            weight[name] = weight.get(name, 0.0) + n * sure
    most = max(letters.values(), default=0)
    return [(name, n, weight[name] / n) for name, n in letters.items() if n == most or name in certain or weight[name] >= SURE * n and n >= SURE_LETTERS]


def field_languages(fields: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """record_kind, record_id, field, langs: array of (lang, n_chars, confidence), empty if the field has no language. One row per row of ``fields``."""
    held = fields.sparkSession.sparkContext.broadcast(texts)  # at most 11 * DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(held.value)
        for batch in batches:
            ends, found = [0], []
            for parts in model.fields(batch.column(3).to_pylist()):
                found += merge(parts)
                ends.append(len(found))
            names, sizes, sure = zip(*found, strict=True) if found else ((), (), ())
            parts = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(sure, pa.float64())], ["lang", "n_chars", "confidence"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["record_kind", "record_id", "field", "langs"])

    rows = fields.select("record_kind", "record_id", "field", "text")
    return rows.mapInArrow(run, "record_kind string, record_id string, field string, langs array<struct<lang:string,n_chars:bigint,confidence:double>>")


def language_segments(fields: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """record_kind, record_id, field, part, segment, lang (null if rejected), confidence: one row per part of a field and copy of it."""
    held = fields.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(held.value)
        for batch in batches:
            take, rows = [], []
            for i, parts in enumerate(model.fields(batch.column(3).to_pylist())):
                for part, (segment, name, sure) in enumerate(parts):
                    take.append(i)
                    rows.append((part, segment, name or None, sure))
            at = pa.array(take, pa.int64())
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["record_kind", "record_id", "field", "part", "segment", "lang", "confidence"])

    rows = fields.select("record_kind", "record_id", "field", "text")
    return rows.mapInArrow(run, "record_kind string, record_id string, field string, part int, segment string, lang string, confidence double")


def wrong_labels(posts: DataFrame, communities: DataFrame, declared_langs: DataFrame) -> DataFrame:
    """record_kind, record_id, field, lang, confidence of every record whose declaration is missing, wrong or too narrow."""
    texts = train(posts.sparkSession, posts, declared_langs)
    found = field_languages(record_fields(posts, communities), texts).select("record_kind", "record_id", "field", F.explode("langs").alias("l"))
    # A language counts once per field, however many copies the record has; only then a record's few rows meet.
    rows = cut(found.groupBy("record_kind", "record_id", "field", F.col("l.lang").alias("lang")).agg(F.max("l.confidence").alias("confidence")))
    record = Window.partitionBy("record_kind", "record_id")
    told = rows.withColumn("low", F.min("lang").over(record)).withColumn("high", F.max("lang").over(record))
    cases = told.join(declarations(declared_langs), ["record_kind", "record_id"], "left").filter(F.col("declared").isNull() | (F.col("low") != F.col("high")) | (F.col("declared").bitwiseAND(code_bit("low")) == 0))
    return cases.select("record_kind", "record_id", "field", "lang", "confidence")
