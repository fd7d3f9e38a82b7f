import random

import pytest

from quarry.llm import common
from quarry.llm import decontaminate as dec

ITEM = "Every morning the baker Anna sells 12 loaves for 3 dollars each and then Anna gives 4 loaves to the old school near the river."
SCHEMA = "doc_id long, text string, item_id string, width string"


def pad(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def frames(spark):
    items = [(1, ITEM), (2, "Short text with five words"), (3, None), (4, ""), (None, "an item without any id at all here now")]
    rows = [
        (0, pad(0)),
        (1, f"{pad(1)} {ITEM} {pad(2)}"),
        (2, pad(3) + " " + ITEM.replace("Anna", "Omar").replace("12", "70").replace("dollars", "euros") + " " + pad(4)),
        (3, pad(5) + " " + ITEM.replace("Anna sells", "Omar sells").replace("then Anna", "then Petra") + pad(6)),
        (4, None), (5, ""), (6, ITEM.split("for")[0] + pad(7)), (7, "short TEXT with five words"), (8, f"x. {ITEM}\n{ITEM}"), (8, f"x. {ITEM}\n{ITEM}"),
        (9, ITEM.replace("the old school near", "the new school near")), (None, ITEM), (None, pad(9)), (0, pad(11) + ITEM), (12, pad(12) + " an item without any id at all here now"),
    ]
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, slots string")


def test_exact_short_and_reparameterised(frames):
    docs, items = frames
    found = dec.contamination(docs, items).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(found) == len(got) and set(got) == {(1, 1), (2, 1), (3, 1), (7, 2), (8, 1), (9, 1), (None, 1), (0, 1), (12, None)}
    assert got[1, 1].coverage == 0.96 and not got[1, 1].reparameterised
    assert got[2, 1].coverage == 0.96 and got[2, 1].reparameterised
    kept = dec.clean_of_benchmark(docs, items)
    assert kept.columns == docs.columns
    # of the two texts under doc_id 0, and of the two rows without one, the clean one stays
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 4, 5, 6]
    assert {r.text for r in kept.where("doc_id is null or doc_id = 0").collect()} == {pad(0), pad(9)}


def test_the_filter_only_saves_work(frames, monkeypatch):
    docs, items = frames
    full = sorted(map(str, dec.contamination(docs, items).collect()))
    monkeypatch.setattr(dec, "BLOOM_LEAST", 64)
    monkeypatch.setattr(dec, "BLOOM_MOST", 64)
    assert sorted(map(str, dec.contamination(docs, items).collect())) == full


def test_keys_are_shuffled_where_they_are_many(frames, monkeypatch):
    docs, items = frames
    few = sorted(map(str, dec.clean_of_benchmark(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, dec.clean_of_benchmark(docs, items).collect())) == few


@pytest.mark.parametrize("item", ["42", "Paris", "12 km", "the", "June 5 1990", "Answer is four"])
def test_items_of_few_words_count_as_lines(spark, item):
    other = item.replace("42", "43").replace("Paris", "Rome").replace("12", "13").replace("the", "a").replace("5", "6").replace("four", "five")
    rows = [(1, f"I have 7 apples and {item} more, {item} {pad(1)}"), (2, f"{pad(2)}\n{item}.\n{pad(3)}"), (3, f"{pad(2)}\n{other}\n{pad(3)}"), (4, item), (5, f"{pad(2)}\n{item} {item}\n"), (6, "7\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dec.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.coverage) for r in got) == [(2, 1.0), (4, 1.0)]


@pytest.mark.parametrize(("item", "template"), [("Add 3 and 4", False), ("Name the river of Rome", True), ("How many km to Rome now", True), ("Is 4 plus 17 odd", False), ("What is 4 plus 17 plus", True), ("7 8 9 10 11 12 13", False), ("Who wrote the book on 3 whales", True)])
def test_items_of_four_to_seven_words(spark, item, template):
    """With four plain words or more they are found re-parameterised, with fewer by their exact words."""
    other = item.replace("3", "5").replace("17", "18").replace("Rome", "Bern").replace("11", "14")
    rows = [(1, f"{pad(1)}. {item} {pad(2)}"), (2, f"{pad(3)}. {other} {pad(4)}"), (3, f"{pad(5)} 1 2 {pad(6)}")]
    got = dec.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == ([1, 2] if template else [1])


def test_a_repetitive_document(spark):
    """Windows of such texts meet all windows of such items; alignments are judged one by one."""
    item = "one more step to the left " * 8
    rows = [(1, "one more step to the left " * 3000), (1, "one more step to the left " * 3000), (2, "one more step to the right " * 3000), (3, "one more step to the left. " * 4)]
    got = dec.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.coverage) for r in got) == [(1, 1.0), (3, 1.0)]  # alignments may differ by repeats of the item itself


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [w for w in pad(1, 60).split()] + ["Mara", "17", "km", "two"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))
    items = [(i, text(rng.randrange(4, 30))) for i in range(15)]
    rows = [(i, " ".join([text(rng.randrange(20)), rng.choice(items)[1] if rng.random() < 0.6 else "", text(rng.randrange(20))])) for i in range(60)]

    def cut(t, width):
        """(start, tokens amid the text, tokens if the first begins a sentence, exact words, contents, plain words) of each window."""
        memo, out, start = dec.Canon(), [], True
        for w in t.encode().split():
            n, k = int(memo.numbers([w])[0]), 0 if start else 1
            out.append((int(memo.hashes[k, n]), int(memo.types[k, n]), w.strip(dec.EDGE).lower().decode(), int(memo.hashes[0, n]), int(memo.types[0, n])))
            start = memo.stops[n]
        for i in range(len(out) - width + 1):
            own = out[i : i + width]
            contents, plain = [x[2] for x in own if x[1]], sum(x[1] == 0 for x in own)
            yield i, tuple(x[0] for x in own), (own[0][3], *(x[0] for x in own[1:])), tuple(x[2] for x in own), contents, plain, own[0][1] != own[0][4], [x[2] for x in own[1:] if x[1]]

    want = set()
    for d, t in rows:
        for i, q in items:
            n = len(q.split())
            width = min(dec.WIDTH, n)
            places = {}
            for a, x, first, exact, slots, plain, moved, rest in cut(t, width):
                for b, y, _, theirs, their_slots, their_plain, _, _ in cut(q, width):
                    if their_plain >= dec.PLAIN and plain >= dec.PLAIN and x == y:
                        places.setdefault(a - b, []).append((b, width, their_slots, slots))
                    if their_plain < dec.PLAIN and exact == theirs:
                        places.setdefault(a - b, []).append((b, width, [], []))
                    if their_plain >= dec.PLAIN and n == width and moved and plain + 1 >= dec.PLAIN and first == y:
                        places.setdefault(a - b, []).append((b, width, their_slots, rest))
            covered = set().union(*(dec.agreeing(h)[0] for h in places.values()))
            if covered and len(covered) >= 0.5 * n:
                want.add((d, i))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dec.contamination(docs, bench).collect()} == want and len(want) > 20
    assert dec.contamination(docs.limit(0), bench).count() == 0 and dec.contamination(docs, bench.limit(0)).count() == 0


def test_placeholder_heavy_items_and_starts_amid_sentences(spark):
    table = "12 kg 40 cm 7 days 3 km 15 g 80 mm 9 hours 22 m 5 years"
    mostly = "Add 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 to the sum"
    items = [(1, table), (2, mostly), (3, "What is the capital of France?"), (4, "Name the largest lake of the old Canton Bern"[:-5])]
    rows = [
        (1, f"{pad(1)} {table} {pad(2)}"), (2, f"{pad(3)}\n{mostly}\n{pad(4)}"), (3, f"{pad(5)}, Question: What is the capital of France? {pad(6)}"),
        (4, f"{pad(7)}\nWhat is the capital of Spain?"), (5, f"{pad(8)}\nName the largest lake of the old Canton {pad(9)}"),
        (6, pad(1) + " " + table.replace("40", "41").replace("15", "16").replace("22", "23") + " " + pad(2)), (7, f"{pad(5)}, Question: Which is the capital of France? {pad(6)}"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dec.contamination(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4)}
    assert got[1, 1].coverage == got[3, 3].coverage == 1 and got[4, 3].reparameterised and not got[3, 3].reparameterised


def test_contents_that_become_equal_or_are_altered_once(spark):
    equal = ITEM.replace("12 loaves", "6 loaves").replace("4 loaves", "6 loaves")
    once = ITEM.replace("then Anna", "then Petra")
    rows = [(1, f"{pad(1)} {equal} {pad(2)}"), (2, f"{pad(3)} {once} {pad(4)}"), (3, f"{pad(5)} {once.replace('Anna', 'Omar')} {pad(6)}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in dec.contamination(docs, bench).collect()}
    assert set(got) == {1, 2, 3}  # where a name becomes two others, what is verbatim or agrees with the more frequent one counts
    assert 0.5 <= got[3].coverage < got[2].coverage
    assert got[1].coverage == 0.96 and got[1].reparameterised and got[2].coverage > 0.9


#: Questions with the contents of their slots, and other contents for these.
QUESTIONS = {
    "en": [
        ("Every morning the baker {Anna} sells {12} loaves for {3} {dollars} each and then {Anna} gives {4} loaves to the old school near the river.", {"Anna": "Omar", "12": "70", "3": "8", "dollars": "euros", "4": "9"}),
        ("A train leaves {London} at {9:15} and travels {120} {km} to the coast; how long does it take if it stops for {twenty} {minutes} on the way?", {"London": "Madrid", "9:15": "7:40", "120": "85", "km": "miles", "twenty": "thirty", "minutes": "hours"}),
        ("If {seven} workers paint a long wall in {5} {days}, how many workers does {Peter} need to paint it in {2} {days}?", {"seven": "twelve", "5": "6", "days": "weeks", "Peter": "Maria", "2": "3"}),
        ("The temperature in {Oslo} fell by {4} {degrees} every hour; what was it after {six} {hours} if it was {10} at noon?", {"Oslo": "Turin", "4": "3", "degrees": "volts", "six": "eight", "hours": "minutes", "10": "21"}),
        ("A farmer named {Luis} keeps {40} sheep and sells a quarter of them at the market for {60} {pounds} apiece before winter comes.", {"Luis": "Greta", "40": "88", "60": "75", "pounds": "dollars"}),
    ],
    "de": [
        ("Ein Händler verkauft am Morgen {zwölf} Körbe mit Äpfeln und am Abend noch {fünf} Kisten mit Birnen, bevor er nach {Bremen} fährt und dort übernachtet.", {"zwölf": "zwanzig", "fünf": "sieben", "Bremen": "Leipzig"}),
        ("Ein Zug fährt um {9} Uhr in {Hamburg} ab und braucht für die ganze Strecke von {280} {Kilometern} genau {drei} {Stunden}; wie schnell ist er?", {"9": "7", "Hamburg": "Stuttgart", "280": "150", "Kilometern": "Metern", "drei": "zwei", "Stunden": "Minuten"}),
        ("Wenn {sieben} Arbeiter eine lange Mauer in {5} {Tagen} streichen, wie viele Arbeiter braucht dann {Peter}, um sie in {2} {Tagen} zu streichen?", {"sieben": "acht", "5": "6", "Tagen": "Wochen", "Peter": "Maria", "2": "3"}),
        ("In der Schule von {Köln} lernen {400} Kinder, von denen ein Viertel mit dem Rad kommt; wie viele kommen zu Fuß, wenn {30} krank sind?", {"Köln": "Jena", "400": "520", "30": "44"}),
        ("Der Bauer hat {vierzig} Schafe und verkauft davon jeden Monat {drei} an einen Nachbarn, der ihm dafür {60} {Euro} gibt; wie viel bekommt er?", {"vierzig": "fünfzig", "drei": "vier", "60": "75", "Euro": "Dollar"}),
    ],
    "fr": [
        ("Chaque matin la boulangère {Anne} vend {douze} pains pour {3} {euros} et donne ensuite {quatre} pains à la vieille école près de la rivière.", {"Anne": "Fatima", "douze": "vingt", "3": "5", "euros": "dollars", "quatre": "six"}),
        ("Un train quitte {Lyon} à {9} {heures} et parcourt {120} {kilomètres} vers la mer ; combien de temps lui faut-il avec un arrêt de {dix} {minutes} ?", {"Lyon": "Brest", "9": "8", "heures": "jours", "120": "95", "kilomètres": "mètres", "dix": "quinze", "minutes": "secondes"}),
        ("Si {sept} ouvriers peignent un long mur en {5} {jours}, combien en faut-il à {Pierre} pour le peindre en {2} {jours} ?", {"sept": "huit", "5": "6", "jours": "semaines", "Pierre": "Louise", "2": "3"}),
        ("La température à {Lille} baisse de {4} {degrés} toutes les heures ; que vaut-elle après {six} {heures} si elle était de {10} à midi ?", {"Lille": "Nice", "4": "3", "degrés": "volts", "six": "huit", "heures": "minutes", "10": "21"}),
        ("Un fermier garde {quarante} moutons et vend le quart de ces bêtes au marché de {Tours} pour {60} {euros} chacune avant que vienne le froid.", {"quarante": "cinquante", "Tours": "Dijon", "60": "75", "euros": "dollars"}),
    ],
    "es": [
        ("Cada mañana la panadera {Ana} vende {doce} panes por {3} {euros} y después regala {cuatro} panes a la vieja escuela que está cerca del río.", {"Ana": "Elena", "doce": "veinte", "3": "5", "euros": "dólares", "cuatro": "seis"}),
        ("Un tren sale de {Madrid} a las {9} y recorre {120} {kilómetros} hasta la costa; ¿cuánto tarda si se detiene {diez} {minutos} en el camino?", {"Madrid": "Bilbao", "9": "8", "120": "95", "kilómetros": "metros", "diez": "quince", "minutos": "horas"}),
        ("Si {siete} obreros pintan un muro largo en {5} {días}, ¿cuántos obreros necesita {Pedro} para pintar ese mismo muro en {2} {días}?", {"siete": "ocho", "5": "6", "días": "semanas", "Pedro": "Lucía", "2": "3"}),
        ("La temperatura en {Burgos} baja {4} {grados} cada hora; ¿cuál será después de {seis} {horas} si al mediodía era de {10}?", {"Burgos": "Soria", "4": "3", "grados": "metros", "seis": "ocho", "horas": "minutos", "10": "21"}),
        ("Un granjero cuida {cuarenta} ovejas y vende la cuarta parte de ellas en el mercado de {Toledo} por {60} {euros} cada una antes del invierno.", {"cuarenta": "cincuenta", "Toledo": "Lugo", "60": "75", "euros": "pesos"}),
    ],
}


def test_reparameterised_in_four_languages(spark):
    """Recall by language of questions in which all slots are filled anew; other questions of the set are not taken for them."""
    items, rows = [], []
    for k, (lang, questions) in enumerate(QUESTIONS.items()):
        for i, (text, other) in enumerate(questions):
            number = 10 * k + i
            items.append((number, text.replace("{", "").replace("}", "")))
            for old, new in other.items():
                text = text.replace("{" + old + "}", new)
            assert "{" not in text
            rows += [(number, f"{pad(number)}. {text} {pad(number + 50)}"), (1000 + number, pad(number + 99, 60))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in dec.contamination(docs, bench).collect()}
    assert all(d == i for d, i in got) and all(got.values())
    recall = {lang: sum((10 * k + i, 10 * k + i) in got for i in range(5)) / 5 for k, lang in enumerate(QUESTIONS)}
    assert recall == {"en": 1, "de": 1, "fr": 1, "es": 1}


def test_a_name_that_becomes_two_others_amid_verbatim_words(spark):
    item = "Long ago Anna walked along the quiet river every single evening and counted the small boats that came home late, while later Anna wrote all their names into a blue book"
    text = item.replace("Anna", "Omar", 1).replace("Anna", "Petra", 1)
    docs = spark.createDataFrame([(1, f"{pad(1)} {text} {pad(2)}")], "doc_id long, text string")
    got = dec.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1] and got[0].coverage > 0.7


def test_very_long_text(spark):
    filler = pad(3, 200_000)
    docs = spark.createDataFrame([(1, f"{filler} {ITEM} {filler}"), (2, filler)], "doc_id long, text string")
    assert [r.doc_id for r in dec.contamination(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()] == [1]
