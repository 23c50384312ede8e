"""Rules of problem 9 that look at more than one unit of a page."""

import time

import pytest

from rillcube.llm import stuffing

PLAIN = "The harbour was quiet when we left it in the morning, and nobody saw us go. She says that the road to the north is closed. "


@pytest.mark.parametrize("page", ["comprar torre es torre. barato torre es torre. precio torre es torre.", "купить дорога — это дорога! дёшево дорога — это дорога! распродажа дорога — это дорога!"])
def test_sentences_around_the_keyword_of_the_page(page):
    total, by_shape, _ = stuffing.shapes(page)
    assert sum(by_shape.values()) == total and stuffing.is_stuffed(page)


def test_a_word_twice_in_one_sentence_of_prose():
    assert not stuffing.is_stuffed(PLAIN * 3 + "A house is a house. " + PLAIN)


MENU = "Home, Products, Prices, Contact, Cart, Login, Register, Downloads, Offers, Brands, Sale, Newsletter"


@pytest.mark.parametrize("sign", ["\t", "\u00ad", "\ufeff", "\x85", "\x93", "\ue000", " " + "x" * 41 + " "])
def test_one_damaged_sign_does_not_clear_a_list(sign):
    assert stuffing.is_stuffed(MENU) and stuffing.is_stuffed(MENU[:30] + sign + MENU[30:])


@pytest.mark.parametrize("text", ["\u00d0\x9a\u00d1\x80\u00d0\u00b0\u00d1\x81\u00d0\u00b8 " * 8, "x" * 400 + " y " + "z" * 300])
def test_damaged_text_is_no_list(text):
    assert not stuffing.is_stuffed(text)


@pytest.mark.parametrize("page", ["https://shop.test/a/very/long/path/to/some/product", "[one](https://a.test/1)\n[two](https://b.test/2)", "¿Quieres torre? comprar torre es torre."])
def test_a_page_of_few_links_or_keywords(page):
    assert stuffing.is_stuffed(page)


def test_a_lone_fragment_is_no_list():
    assert not stuffing.is_stuffed("a lone fragment") and not stuffing.is_stuffed("The road follows the road because the road is easy")


def test_list_text_of_many_shapes():
    ends = ["", " *", " #x", " AB-12", "!", " (3)", " >", " |", ", x, y", ", x, y, z, v, w, u", ": a", "; b; c; d", " = 3", " / e / f", " HOME"]
    page = "\n".join(f"{w}{e}" for e in ends for w in ("Home", "next page", "cart login help"))
    total, by_shape, _ = stuffing.shapes(page)
    assert len(by_shape) > stuffing.TOP_SHAPES and sum(by_shape.values()) == total and stuffing.is_stuffed(page)
    assert not stuffing.is_stuffed(page + "\n" + PLAIN * 20)


def test_prose_that_names_a_thing_twice():
    assert not stuffing.is_stuffed("The letter needs the letter once a year. The river needs the chair since yesterday. The letter needs the letter once a year.")


# languages and patterns that the tables do not have
HELD_OUT_PROSE = {
    "fi": "Vanha talo seisoi joen rannalla, ja sen ikkunoista näki kauas metsään. Kukaan ei ollut asunut siellä vuosiin. Eräänä syysiltana sinne muutti nuori pariskunta, joka oli kyllästynyt kaupungin meluun. He korjasivat katon ennen talvea ja istuttivat pihalle omenapuita.",
    "pl": "Wieczorem wróciliśmy do domu, bo padał deszcz. Babcia czekała z kolacją i opowiadała o dawnych czasach. Nikt z nas nie wiedział, że ta rozmowa będzie ostatnia! Następnego dnia pojechała nad morze, skąd napisała do nas jeszcze jeden list.",
    "tr": "Sabah erkenden yola çıktık ve dağın eteğine öğlene doğru vardık. Hava serindi, ama güneş yüzümüzü ısıtıyordu. Rehberimiz bize bölgenin tarihini anlattı. Akşam olunca ateşin başında oturup çay içtik.",
    "it": "Il professore entrò in aula senza salutare nessuno. Aprì la finestra, guardò il cortile e cominciò a parlare della guerra. Gli studenti prendevano appunti in silenzio. Solo alla fine qualcuno trovò il coraggio di fare una domanda.",
    "pt": "A cidade acordou coberta de neblina, e os barcos ficaram no porto até ao meio-dia. Os pescadores jogavam às cartas no café da esquina. Quando o sol apareceu, ninguém quis sair para o mar.",
    "nl": "De trein had twintig minuten vertraging, maar niemand op het perron leek zich daaraan te storen. Een meisje las hardop voor uit een boek over walvissen. Haar vader luisterde met gesloten ogen.",
    "el": "Το πλοίο έφυγε πριν ξημερώσει και κανείς δεν το είδε. Στο λιμάνι έμειναν μόνο δύο γάτες και ένας γέρος ψαράς. Μας είπε ότι ο καιρός θα αλλάξει μέχρι το βράδυ.",
    "hu": "A könyvtár zárva volt, ezért a parkban olvastam tovább a regényt. Egy idős úr leült mellém, és megkérdezte, miről szól. Sokáig beszélgettünk az írókról, akiket mindketten szerettünk.",
    "en": "Install the package before you change the settings. The server reads its configuration once, when it starts; later edits have no effect until it is restarted. If the log shows a warning about the cache, remove the folder and try again.",
    "en dialogue": "ANNA: Did you lock the door last night?\nBEN: I thought that you had done it.\nANNA: Then somebody has been in here, because the drawer is open.\nBEN: Call your brother before you touch anything.",
    "en list of sentences": "1. Fill the kettle with fresh water.\n2. Wait until it boils, then pour it over the leaves.\n3. Let the tea stand for four minutes.\n4. Take the leaves out and serve it at once.",
    "sv": "När vintern kom frös sjön till is på en enda natt. Barnen sprang ut med sina skridskor innan någon hann varna dem. Lyckligtvis höll isen, och på kvällen tände de en eld på stranden.",
}
HELD_OUT_LISTS = {
    "fi": "halvat kengät, kengät netistä, kengät alennus, naisten kengät, parhaat kengät, kengät tarjous, osta kengät, kengät Helsinki",
    "pl": "Tanie buty, buty online, buty damskie, promocja buty. Najlepsze buty, buty tanio, sklep buty, buty wyprzedaż. Buty, buty i buty.",
    "tr": "ucuz ayakkabı satın al ayakkabı fiyatları\nayakkabı indirim en iyi ayakkabı\nonline ayakkabı ucuz ayakkabı\nayakkabı kampanya kadın ayakkabı\nayakkabı fiyatları ucuz",
    "it": "Home | Chi siamo | Prodotti | Offerte | Contatti | Carrello | Accedi | Mappa del sito | Privacy",
    "pt": "Início\nProdutos (12)\nPromoções\nContato\nCarrinho\nEntrar\nAjuda\nMapa do site\nTopo",
    "nl": "Onze fiets is de goedkope fiets voor fiets vrienden. Onze fiets is de nieuwe fiets voor fiets vrienden. Wil je fiets? Beste fiets is fiets! Onze fiets is de online fiets voor fiets vrienden.",
    "el": "παπούτσια φθηνά, παπούτσια online, αγορά παπούτσια, παπούτσια προσφορά, γυναικεία παπούτσια, παπούτσια εκπτώσεις",
    "hu": "https://pelda.example/a/b.html\nhttps://pelda.example/c/d.html\nwww.masik.example/lista\n[cipő](http://bolt.example/cipo)",
    "en products": "Drill XT-4400 (M) // Saw XT-310 discount // Hammer XT/82 14.99 // Drill XT-4500 // Wrench XT-77 sale",
    "en tags": "tags: travel,beach,summer_2019,hotel12,cheap,beach,sun,travel_tips,island,budget,beach7",
    "en phrases": "Cheap flights Rome. Cheap flights Paris cheap hotel. Best cheap flights hotel deals. Rome hotel cheap flights deals. Cheap flights hotel Paris deals. Flights Rome deals cheap hotel Rome.",
    "sv": "Skor  Kläder  Rea (40)  Kontakt  Varukorg  Logga in  Hjälp  Om oss  Nyheter  Rea",
}


@pytest.mark.parametrize("name", HELD_OUT_PROSE)
def test_held_out_prose(name):
    assert not stuffing.is_stuffed(HELD_OUT_PROSE[name])


@pytest.mark.parametrize("name", HELD_OUT_LISTS)
def test_held_out_lists(name):
    assert stuffing.is_stuffed(HELD_OUT_LISTS[name])


def test_one_pattern_of_sentences_is_no_keyword_list():
    lines = [f"The {a} costs {n} pounds, but the {b} is {c}." for n, (a, b, c) in enumerate([("lamp", "door", "old"), ("door", "lamp", "green"), ("shelf", "table", "new"), ("table", "lamp", "old"), ("door", "shelf", "green"), ("lamp", "table", "new")], 3)]
    assert not stuffing.is_stuffed("\n".join(lines)) and not stuffing.is_stuffed("\n".join(x.lower() for x in lines))


@pytest.mark.parametrize("text", ["a-" * 60_000, "[" * 120_000, "x." * 60_000, "<a " * 40_000, "! " * 60_000, "A1 " * 40_000, "，" * 100_000, "word " * 50_000, "." * 100_000 + "\"" * 100_000])
def test_very_long_texts_take_no_longer_than_their_length(text):
    began = time.perf_counter()
    stuffing.is_stuffed(text)
    assert time.perf_counter() - began < 10
