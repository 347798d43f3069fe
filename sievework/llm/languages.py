"""Which language a text is in: profiles of letter groups, frequent words and alphabets.

Each language has a sample (the opening of the Universal Declaration of Human Rights and a
sentence on taxes), its most frequent words and its alphabet.  A text is given to the language
whose profile makes its letter groups likeliest; letters a language does not have speak
against it, its frequent words for it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import log

# Scripts that one language, or one group of them, is told by alone.
SCRIPTS = (
    ("el", "Ͱ-Ͽἀ-῿"), ("hy", "԰-֏"), ("he", "֐-׿"), ("ar", "؀-ۿݐ-ݿ"), ("hi", "ऀ-ॿ"), ("th", "฀-๿"),
    ("ka", "Ⴀ-ჿ"), ("ko", "ᄀ-ᇿ가-힯"), ("ja", "぀-ヿ"), ("zh", "一-鿿"),
)
CYRILLIC, LATIN = re.compile("[Ѐ-ԯ]"), re.compile("[A-Za-zÀ-ɏḀ-ỿ]")

# Alphabets beside the letters common to a script.
_CYRILLIC = "абвгдежзиклмнопрстуфхцчш"
_LATIN = "abcdefghijklmnoprstuvz"
ALPHABETS = {
    "ru": _CYRILLIC + "ёйщъыьэюя", "uk": _CYRILLIC + "ґєіїйщьюя", "be": _CYRILLIC.replace("и", "") + "ёійўыьэюя", "bg": _CYRILLIC + "йщъьюя", "sr": _CYRILLIC + "ђјљњћџ", "mk": _CYRILLIC + "ѓѕјљњќџ", "kk": _CYRILLIC + "әёғйқңөұүһщъыіьэюя",
    "en": _LATIN + "qwxyk", "de": _LATIN + "qwxykäöüß", "fr": _LATIN + "qwxykàâçéèêëîïôùûüœæ", "es": _LATIN + "qwxykáéíñóúü", "it": _LATIN + "qwxykàèéìíòóù", "pt": _LATIN + "qwxykàáâãçéêíóôõú", "nl": _LATIN + "qwxykéëïóö",
    "pl": _LATIN + "wykąćęłńóśźż", "cs": _LATIN + "wxykáčďéěíňóřšťúůýž", "tr": _LATIN + "ykçğıöşüâî", "sv": _LATIN + "qwxykåäöé", "fi": _LATIN + "wykäöå", "ro": _LATIN + "xykăâîșțşţ", "hu": _LATIN + "ykáéíóöőúüű",
}

# The most frequent words.
WORDS = {
    "ru": "и в не на с что по при если когда для без из до или за это как его о об от он мы вы я да нет так же года ли у к но а то все также который которые",
    "uk": "і й та що до це як який якщо він від за протягом після або не є щодо цього цьому звіт у на з ми ви так також які для без",
    "be": "і ў у не на з што па пры калі для без да ці за гэта як яго аб ад ён мы вы я так жа або таксама які якая",
    "bg": "се през според са към като това този тези който може ще не за на от срок отговаря случай други и в с да е при или също че по",
    "sr": "и у не на са што по при ако када за без из до или је као његов о од он ми ви да тако се су који која ово",
    "mk": "и во не на со што по при ако кога за без од до или е како неговиот тој ние вие да исто се кој која ова",
    "kk": "және мен бір бұл үшін жоқ бар емес болып бойынша туралы егер немесе осы сол деп оның кейін дейін",
    "en": "the of and to in is a for on by with if when no not yes this that from or it an are be at as you your which has have may must",
    "de": "der die das und ist nicht mit für von zu im den des ein eine wird bis auf über nach hier keine dem sich auch als es an",
    "es": "el la los las de en y que no es se por con según un una del al para este hace su lo como más",
    "fr": "le la les de et en que est pas pour dans un une du des par avec sur ce cette aux au il qui ne se",
    "it": "il lo la gli di e che non è per con un una del della nel si al dei le in da sono anche",
    "pt": "o a os as de em e que não é se por com um uma do da dos das para este no na ao mais ou",
    "nl": "de het een en van in is niet dat op te voor met zijn aan door bij als of ook naar er wordt",
    "pl": "i w nie na z że do się jest po przy jeśli od lub za to jak jego o oraz dla przez są ten która",
    "cs": "a v ne na s že do se je po při pokud od nebo za to jak jeho o pro jsou ten která není být",
    "tr": "ve bir bu için ile de da değil olarak olan gibi daha çok ne var yok veya her kadar sonra",
    "sv": "och i att det som en på är av för med den till inte om har de ett vid eller också",
    "fi": "ja on ei se että en hän oli mutta tai kun niin myös ovat jos sen joka mukaan",
    "ro": "și în de la nu este că cu pe un o pentru din se sau care prin sunt mai după al",
    "hu": "a az és nem hogy egy is van ez meg csak vagy ha mint már el kell volt lehet",
}

# Text samples, the first two from the Declaration.
SAMPLES = {
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства каждый человек должен обладать всеми правами и всеми свободами налог уплачивается по ставке в срок организация представляет декларацию и вправе заявить вычет",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства кожна людина повинна мати всі права і всі свободи податок сплачується за ставкою у строк організація подає декларацію і має право заявити відрахування",
    "be": "усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах яны надзелены розумам і сумленнем і павінны ставіцца адзін да аднаго ў духу брацтва кожны чалавек павінен валодаць усімі правамі і ўсімі свабодамі падатак выплачваецца па стаўцы ў тэрмін арганізацыя падае дэкларацыю і мае права на вылік",
    "bg": "всички хора се раждат свободни и равни по достойнство и права те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство всеки човек има право на всички права и свободи данъкът се плаща по ставката в срок организацията подава декларация и има право на приспадане",
    "sr": "сва људска бића рађају се слободна и једнака у достојанству и правима она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства сваком припадају сва права и слободе порез се плаћа по стопи у року организација подноси пријаву и има право на одбитак",
    "mk": "сите човечки суштества се раѓаат слободни и еднакви по достоинство и права тие се обдарени со разум и совест и треба да се однесуваат еден кон друг во духот на општо човечката припадност секому му припаѓаат сите права и слободи данокот се плаќа по стапка во рок организацијата поднесува пријава",
    "kk": "барлық адамдар тумысынан азат және қадір қасиеті мен құқықтары тең болып дүниеге келеді адамдарға ақыл парасат ар ождан берілген сондықтан олар бір бірімен туыстық бауырмалдық қарым қатынас жасаулары тиіс салық мөлшерлеме бойынша мерзімінде төленеді ұйым декларация ұсынады",
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood everyone is entitled to all the rights and freedoms set forth in this declaration the tax is paid at the rate in time the company files a return and may claim a deduction",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen jeder hat anspruch auf die in dieser erklärung verkündeten rechte und freiheiten die steuer wird zum satz fristgerecht gezahlt das unternehmen gibt eine erklärung ab",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité chacun peut se prévaloir de tous les droits et de toutes les libertés l impôt est payé au taux dans le délai la société dépose une déclaration",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros toda persona tiene todos los derechos y libertades proclamados en esta declaración el impuesto se paga al tipo en el plazo la empresa presenta una declaración",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza ad ogni individuo spettano tutti i diritti e tutte le libertà l imposta si paga con l aliquota entro il termine la società presenta una dichiarazione",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade todos os seres humanos podem invocar os direitos e as liberdades proclamados o imposto é pago à taxa no prazo a empresa apresenta uma declaração e tem direito à dedução",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen een ieder heeft aanspraak op alle rechten en vrijheden de belasting wordt op tijd betaald het bedrijf doet aangifte en heeft recht op aftrek",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności podatek płaci się według stawki w terminie organizacja składa deklarację i ma prawo do odliczenia",
    "cs": "všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství každý má všechna práva a všechny svobody daň se platí podle sazby ve lhůtě organizace podává přiznání a má nárok na odpočet",
    "tr": "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler herkes bu beyannamede ilan olunan bütün haklardan ve hürriyetlerden istifade edebilir vergi süresi içinde oranına göre ödenir kuruluş beyanname verir ve indirim hakkına sahiptir",
    "sv": "alla människor är födda fria och lika i värde och rättigheter de har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap var och en är berättigad till alla rättigheter och friheter skatten betalas i tid företaget lämnar en deklaration och har rätt till avdrag",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin oikeuksiin ja vapauksiin vero maksetaan ajoissa yritys antaa ilmoituksen ja saa vähennyksen",
    "ro": "toate ființele umane se nasc libere și egale în demnitate și în drepturi ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității fiecare se poate prevala de toate drepturile și libertățile impozitul se plătește la termen societatea depune o declarație",
    "hu": "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek mindenki hivatkozhat a jogokra és szabadságokra az adót határidőre kell megfizetni a társaság bevallást nyújt be",
}

# Endings of longer words that tell a language without letters of its own.
ENDINGS = {"bg": re.compile(r"\w{3,}(?:ът|ият|ята|ата|ото|ието)$")}

_WORD = re.compile(r"[^\W\d_]+")
#: Own letters, words and endings that must speak for a language other than the usual one.
EVIDENCE = 2
#: Nats by which another language must beat the usual one of its script.
MARGIN = 5.0
#: Nats for a frequent word of a language, against a letter it does not have.
FREQUENT, FOREIGN = 2.0, 4.0


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@lru_cache(1)
def _profiles() -> dict[str, tuple[dict[str, float], float, frozenset, frozenset]]:
    """For each language: log likelihoods of its letter groups, that of any other group, its
    frequent words and its alphabet."""
    out = {}
    for code, sample in SAMPLES.items():
        frequent = WORDS[code].split()
        seen = Counter(g for w in sample.split() + frequent for g in _grams(w))
        # One size for all, so that a longer sample makes nothing less likely.
        scale = 1000 / sum(seen.values())
        out[code] = {g: log((n * scale + 0.25) / 1500) for g, n in seen.items()}, log(0.25 / 1500), frozenset(frequent), frozenset(ALPHABETS[code])
    return out


@lru_cache(None)
def _own(code: str, usual: str) -> tuple[frozenset, float]:
    """The letters a language has beyond those of another, and their share in its sample."""
    own = frozenset(ALPHABETS[code]) - frozenset(ALPHABETS[usual])
    sample = SAMPLES[code].replace(" ", "")
    return own, sum(ch in own for ch in sample) / len(sample)


def _evidence(words: Counter, code: str, usual: str) -> int:
    own, ending = _own(code, usual)[0], ENDINGS.get(code)
    frequent = _profiles()[code][2] - _profiles()[usual][2]
    return sum(n * (sum(ch in own for ch in w) + (w in frequent) + bool(ending and ending.search(w))) for w, n in words.items())


def likeliest(text: str, codes: tuple[str, ...], usual: str) -> str:
    """The best of ``codes``; the usual language unless another is clearly likelier."""
    words, profiles = Counter(_WORD.findall(text)), _profiles()
    letters, length = set("".join(words)), sum(len(w) * n for w, n in words.items())
    # Nor is a language in question whose own letters should have come by now.
    codes = tuple(code for code in codes if code == usual or not (_own(code, usual)[1] * length > 4.6 and not letters & _own(code, usual)[0]))
    # A language whose alphabet has all letters, while every other lacks some, is the one.
    able = [code for code in codes if letters <= profiles[code][3]]
    if able == [usual]:
        return usual
    hits = {code: sum(n for w, n in words.items() if w in profiles[code][2]) for code in codes}
    if usual in able and hits[usual] >= 3 and hits[usual] >= 3 * max(n for code, n in hits.items() if code != usual):
        return usual
    scores = {}
    for code in codes:
        groups, other, frequent, alphabet = profiles[code]
        scores[code] = sum(n * (sum(groups.get(g, other) for g in _grams(w)) + FREQUENT * (w in frequent) - FOREIGN * sum(ch not in alphabet for ch in w)) for w, n in words.items())
    best = max(scores, key=scores.get)
    return best if scores[best] - scores[usual] > MARGIN and _evidence(words, best, usual) >= EVIDENCE else usual


_BY_SCRIPT = {k: tuple(c for c in ALPHABETS if (ALPHABETS[c][0] == "а") == (k == "ru")) for k in ("ru", "en")}


def language(text: str) -> str | None:
    """The language most of the letters are in; None without letters."""
    text = text.lower()
    cyrillic, latin = len(CYRILLIC.findall(text)), len(LATIN.findall(text))
    counts = {code: len(re.findall(f"[{span}]", text)) for code, span in SCRIPTS} if not text.isascii() and len(text) > cyrillic + latin else {}
    if counts.get("ja"):
        counts["ja"] += counts.pop("zh", 0)  # kana stand among Chinese characters
    other, n = max(counts.items(), key=lambda x: x[1], default=("", 0))
    if n > max(cyrillic, latin):
        return other
    if not cyrillic + latin:
        return None
    return likeliest(text, _BY_SCRIPT["ru"], "ru") if cyrillic >= latin else likeliest(text, _BY_SCRIPT["en"], "en")
