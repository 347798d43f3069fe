"""Question and answer pairs that cannot serve as such.

Five defects: ``empty``, ``truncated``, ``refusal``, ``copied_question``, ``other_language``.
Copies are found by compressing the answer with its question as a Zstandard dictionary, and the
question with the answer; languages by profiles of letter groups with frequent words; refusals
by dictionaries of who speaks, of what and how it is out of reach; truncation by the terminal
context: how often the words an answer stops at end a sentence in all answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.llm import languages
from sievework.sources import with_columns

#: Share of the bytes that the other text as dictionary must spare, of answer and question, and
#: of new words a sentence of a copy may have.
COPY_SPARED, COPY_CHANGED = 0.4, 0.25
#: An answer without a final stop is complete if its last words end a sentence this often.
ENDS_OFTEN = 0.2

#: Words of the longest sentence that declines; longer ones say something.
LONGEST_REFUSAL = 25

_CITE = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_BLANK = re.compile("[\\s​-‏⁠﻿]+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n+")
_STOP = re.compile(r"[.!?…][»”\"')\]*_]*$")
# What may follow the last sentence.
_TRAILER = re.compile(r"(?:(?:ссылк[аи]|источник[и]?|references?|sources?)\s*:[\s,;.]*|(?:подробнее|см\.?(?: также)?)(?: в)? источник[еи]?|see also sources?|source)[\s,;.]*$", re.I)

def _any(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


# The dictionaries a refusal is told by.  A sentence declines if it says that the
# answerer cannot or will not speak, that the material holds no answer, or that an answer or
# the question is out of reach; what a person or authority may not do is no refusal.
_ACT_RU = _any(
    r"ответ\w*", r"отвеч\w*", r"сказать", r"скаж\w+", r"подска\w+", r"помо(?:чь|г\w+|щ\w+)", r"\w*консульт\w+", r"обсужда\w+", r"обсуд\w+", r"\w*комментир\w+", r"комментари\w+", r"разъясн\w+", r"поясн\w+", r"судить", r"рассужда\w+",
    r"высказ\w+", r"сообщ\w+", r"назвать", r"прояснить", r"заключени[ея]", r"совет\w*", r"рекоменд\w+", r"мнени\w+", r"оценк\w+", r"оценить", r"утверждать", r"суждени\w+", r"вывод\w*", r"разобрать(?:ся)?", r"разбирать", r"рассм[ао]тр\w+", r"определить",
)
_TOPIC_RU = _any(r"вопрос\w*", r"запрос\w*", r"тем[аыуео]й?", r"темам?и?", r"тематик\w+", r"обращени\w+", r"об этом", r"об этой", r"про это", r"на это", r"по этому", r"такое", r"такого рода", r"здесь", r"тут", r"поводу", r"ситуаци\w+", r"предмет\w*")
_INFO_RU = _any(r"сведени\w+", r"информаци\w+", r"данны[хе]", r"материал\w*", r"ответ\w*", r"знани\w+", r"указани\w+", r"разъяснени\w+", r"подходящ\w+", r"полезн\w+", r"релевантн\w+", r"нужн\w+", r"относящ\w+", r"упоминани\w+", r"подсказ\w+", r"контекст\w*", r"основани\w+ для (?:ответа|вывода|суждения)")
_MATERIAL_RU = _any(r"источник\w*", r"контекст\w*", r"фрагмент\w*", r"выдерж\w+", r"материал\w*", r"отрыв\w+", r"подборк\w+", r"баз\w+ знаний", r"документ\w*", r"текст\w*", r"передан\w+", r"предоставлен\w+", r"предложенн\w+", r"найденн\w+", r"загруженн\w+", r"приложенн\w+", r"приведенн\w+", r"поиск\w*", r"корпус\w*", r"архив\w*")
_LACK_RU = _any(
    r"нет", r"не содерж\w+", r"отсутству\w+", r"не наш\w+", r"не найден\w*", r"не обнаруж\w+", r"недостаточно", r"не ?хвата\w+", r"мало", r"маловато", r"скуд\w+", r"пуст\w*", r"ничего", r"ни слова", r"не упомина\w+", r"не упомянут\w*", r"не говорится", r"не сказано", r"не раскры\w+", r"не освещ\w+", r"не описан\w*",
    r"не затрагива\w+", r"не затронут\w*", r"не каса\w+", r"не относ\w+", r"не помога\w+", r"не позволя\w+", r"не да[ею]т", r"умалчива\w+", r"молчат?", r"бесполезн\w*", r"не представлен\w*", r"не попал\w*", r"не видно", r"не встреч\w+", r"обрыва\w+", r"не охватыва\w+",
)
_CANNOT_RU = _any(
    r"невозможно", r"нельзя", r"не (?:получится|получается|удастся|удается|удалось|выйдет|вышло)", r"не представляется возможным", r"не берусь", r"не беремся", r"не возьмусь", r"не могу", r"не можем", r"не смогу", r"не сможем", r"не вправе", r"не готов\w*", r"не буду", r"не будем", r"не стану", r"не станем", r"не хочу", r"не хотелось бы", r"не хотел\w* бы", r"не решусь", r"не рискну",
    r"не уполномочен\w*", r"не умею", r"не умеем", r"не сумею", r"не сумеем", r"не намерен\w*", r"не имею (?:права|возможности)", r"не имеем (?:права|возможности)", r"нет возможности", r"нет права", r"запрещено", r"не разрешено", r"не дозволено", r"не положено", r"трудно", r"сложно", r"затруднительно", r"затрудн\w+", r"не в силах", r"не в состоянии", r"нечего", r"не приходится", r"бессил\w+", r"воздерж\w+",
)
_SPEAKER_RU = _any("я", "мы", "мне", "меня", "мной", "нам", "нас", "мой", "моя", "мое", "мои", "моей", "моих", "моего", "моем", "моими", "моим", "мою", r"наш\w*", "ассистент", "помощник", "модель", "чат-бот", "бот", r"сервис\w*", r"справочн\w+ служб\w+", r"поддержк\w+")
_FIRST_RU = _any(
    "знаю", "знаем", "отвечу", "ответим", "отвечаю", "отвечаем", "скажу", "скажем", "подскажу", "подскажем", "помогу", "поможем", "помогаю", "дам", "дадим", "располагаю", "располагаем", "обладаю", "обладаем", "владею", "владеем", "касаюсь", "касаемся", "обсуждаю", "обсуждаем", "комментирую", "комментируем",
    "консультирую", "консультируем", "занимаюсь", "занимаемся", "рассматриваю", "рассматриваем", "разбираю", "разбираем", "разбираюсь", "разбираемся", "сужу", "судим", "высказываюсь", "нахожу", "находим", "нашел", "нашла", "нашли", "вижу", "видим", "помню", "слышал", "встречал", "проясню", "поясню", "разъясню", "возьмусь", "берусь", "беремся", "осведомлен", "осведомлена", "компетентен", "компетентна", "компетентны", "обучен", "обучена", "специалист", "сориентирую",
)
_B, _E = r"(?<!\w)", r"(?!\w)"


def _near(*parts: str) -> str:
    """All of the parts in one sentence, in any order."""
    return "^" + "".join(f"(?=.*{_B}{p}{_E})" for p in parts)


_REFUSALS = [
    re.compile(x)
    for x in (
        # Who answers: cannot speak, does not know, has nothing.
        _near(_any(r"не могу", r"не можем", r"не смогу", r"не сможем", r"не буду", r"не будем", r"не стану", r"не станем", r"не берусь", r"не беремся", r"не возьмусь", r"не решусь", r"не рискну", r"не хочу", r"не умею", r"не сумею", r"не готова?"), _any(_ACT_RU, _TOPIC_RU, _INFO_RU)),
        _near(rf"не (?:\w+ )?{_FIRST_RU}", _any(_ACT_RU, _TOPIC_RU, _INFO_RU, "этого", "этом", "этой", "этим", "такого", "таких", "таким")),
        rf"^(?:\w+,? ){{0,4}}не (?:{_FIRST_RU}|могу|можем|смогу|буду|стану|берусь)[\s.!,]*$",
        _near(_SPEAKER_RU, _any(r"неизвестн\w+", "ничего", r"отсутству\w+", "нет", r"недоступн\w+", r"незнаком\w*", "не под силу", r"запрещ\w+", r"не разреш\w+", "не по силам", "не хватает", "недостаточно", "мало"), _any(_ACT_RU, _TOPIC_RU, _INFO_RU, r"неизвестн\w+", "возможности", r"практик\w+", "доступа")),
        _near(_SPEAKER_RU, _any("не вправе", r"не уполномочен\w*", "не имею права", "не имеем права", r"не должн\w+", r"не намерен\w*", "не готовы?", r"не предназначен\w*", r"не рассчитан\w*", r"не настроен\w*", r"не обучен\w*", r"не компетентн?\w*", r"не оказыва\w+", r"не предоставля\w+", r"не да[ею]т", r"не выда[ею]т", r"не занимает\w*", r"не консультир\w+", r"не отвеча\w+", r"не рассматрива\w+", "не может", "не могут"), _any(_ACT_RU, _TOPIC_RU)),
        _near(_any(r"отказываюсь", r"отказываемся", r"воздержусь", r"воздержимся", r"воздерживаюсь", r"воздерживаемся", r"затрудняюсь", r"затрудняемся", r"вынужден\w* (?:отказать|отказаться|воздержаться|отклонить|промолчать)", r"предпочту (?:не|промолчать|воздержаться)", r"предпочитаю не", r"промолчу", r"отклоняю", r"пас")),
        # The material holds no answer.
        _near(_MATERIAL_RU, _LACK_RU, _any(_INFO_RU.replace(r"материал\w*|", "").replace(r"|контекст\w*", ""), _TOPIC_RU, _ACT_RU, "об этом")),
        rf"^(?:[\w-]+,? ){{0,4}}(?:{_any('контекст', 'подборка', 'материал', 'материала', 'материалы', 'поиск', 'база', 'источники', 'фрагменты', 'выдержки', 'сведения', 'данные')}) (?:\w+ ){{0,3}}{_any(r'пуст\w*', r'скуд\w+', r'слишком \w+', 'ничего не дали?', 'недостаточны?', 'отсутствуют', 'отсутствует', 'ни о чем')}",
        # No information for an answer.
        _near(_any("нет", "недостаточно", r"не ?хвата\w+", "мало", "маловато", r"отсутству(?:ет|ют)", r"не найден\w*", r"не наш\w+", r"не обнаружен\w*", r"не удалось (?:найти|подобрать|получить|отыскать|обнаружить)", r"не имеется", r"не встретил\w+", r"не попал\w+"), _INFO_RU, _any("для ответа", "чтобы ответить", "для вывода", r"для (?:уверенного|точного|полного|обоснованного) \w+", "по теме", rf"(?:по|на|о|об|про) (?:эт\w+|данн\w+|ваш\w+|так\w+|указанн\w+|поставленн\w+|заданн\w+) {_TOPIC_RU}", "ответить")),
        rf"^(?:[\w-]+,? ){{0,3}}(?:нет|недостаточно|не хватает|мало|слишком мало|отсутствуют|отсутствует|не найдено|не нашлось) (?:\w+ ){{0,2}}(?:данных|сведений|информации|материалов|контекста|ответа|нужного)[\s.!]*$",
        rf"^(?:[\w-]+,? ){{0,3}}(?:данных|сведений|информации|материалов|контекста|ответа) (?:\w+ ){{0,3}}(?:нет|недостаточно|не хватает|мало|не найдено|не нашлось|не имеется|не обнаружено|не будет)[\s.!;]*(?:$|попроб|обрат|уточн)",
        r"(?<!\w)ничего (?:подходящего |полезного |нужного |толкового |определенного |внятного |конкретного |по (?:теме|существу|делу) |на этот счет |об этом |об этой теме )(?:\w+ ){0,3}не",
        r"(?<!\w)(?:ничего не (?:нашлось|найдено|нашел|нашла|нашли|известно|скажу|подскажу|могу|знаю|обнаружено)|нечего (?:сказать|ответить|добавить|предложить|посоветовать|сообщить))(?!\w)",
        # An answer, or the question itself, is out of reach.
        _near(_CANNOT_RU, _any("ответить", "отвечать", "подсказать", "помочь", r"\w*консультировать", r"\w*комментировать", "обсуждать", "обсудить", "высказаться", r"(?:дать|давать|получить|сформулировать|подготовить|составить|найти) (?:\w+ ){0,3}(?:ответа?|консультаци\w+|заключени[ея]|совета?|разъяснени\w+|рекомендаци\w+|пояснени\w+|комментари\w+|оценк\w+)", "сказать", "судить")),
        _near(_CANNOT_RU, _any("разобрать", "разбирать", "рассмотреть", "оценить", "определить", "утверждать", "назвать", "прояснить", "сделать вывод", "рассуждать", "заключить"), _TOPIC_RU),
        r"(?<!\w)(?:ответа? (?:\w+ ){0,4}(?:не будет|нет|не последует|не существует|не нашлось|не найдено|не дам|не дадим|не имею|не имеется|не знаю|не найти|не получилось|не предусмотрен\w*)|без ответа|оставлю без|оставляю без|не да[ею]т (?:\w+ ){0,3}консультаци\w+|нет ответа)(?!\w)",
        _near(_any(r"вопрос\w*", r"тем[ау]", r"запрос\w*", "это", "такое", r"обращени\w+", "ответ", "предмет"), _any(r"(?:за|вне) (?:\w+ )?(?:рамк\w+|предел\w+|компетенци\w+|област\w+|сфер\w+|тематик\w+|круг\w*|полномочи\w+)", r"не (?:в|входит в|относится к) (?:\w+ )?(?:мо\w+|наш\w+)", "не по адресу", "не ко мне", "не ко нам", "не к нам", "не мой профиль", "не обсуждается", "не рассматривается", "не поддерживается", "не комментируется", "не для меня")),
        _near(r"(?:за|вне) (?:\w+ )?(?:рамк\w+|предел\w+|компетенци\w+|област\w+|сфер\w+)", r"(?:мо(?:ей|их|ем|его|ими)|наш(?:ей|их|ем|его|ими)|сервиса|ассистента|помощника)"),
        # English: who answers.
        _near(_any("i", "i'm", "i've", "we", "we're", "my", "our", "me", "us", "an? (?:ai|assistant|model|bot)", "this (?:assistant|service|bot|model|tool)", "the assistant"), _any("cannot", "can't", "can not", "not able", "unable", "could not", "couldn't", "won't", "will not", "would not", "wouldn't", "do not", "don't", "did not", "didn't", "does not", "doesn't", "am not", "are not", "aren't", "isn't", "is not", "i'm not", "have no", "has no", "had no", "have nothing", "haven't", "have not", "lack", "lacks", "nothing", "not permitted", "not allowed", "not going", "nor", "no", "never", "avoid", "prefer not", "rather not", "refuse", "decline", "refrain", "regret"), _any(r"answer\w*", r"help\w*", "say", "tell", r"comment\w*", r"advi[cs]e", r"advising", r"discuss\w*", r"respon\w+", "provide", "give", "offer", "address", "know", "known", "idea", "information", "knowledge", "opinion", "speak", "find", "found", "determine", "confirm", "assist", "judge", "take up", "question", "questions", "topic", "topics", "subject", "request", "matter", "matters", "context", "sources?", "excerpts?", "answers", "guidance", "view", "suggest", "recommend", "explain", "clarify", "conclusion", "trained", "equipped", "expertise", "qualified", "position", "data", "insight")),
        _near(_any("i", "we"), _any("must decline", "have to decline", "need to decline", "decline to", "refuse", "refrain", "will pass", "must refuse", "have to refuse", "would rather not", "prefer not to", "know nothing", "have to pass", "will abstain", "abstain", "decline")),
        r"^(?:[\w']+,? ){0,4}(?:i|we) (?:really |simply |honestly |just )?(?:cannot|can't|won't|will not|do not know|don't know|am unable|am not able|have no idea)[\s.!]*$",
        # The material.
        _near(_any("context", "excerpts?", "passages?", "materials?", "sources?", "documents?", "fragments?", "texts?", "extracts?", "provided", "supplied", "retrieved", "knowledge base", "search", "results?", "records? found"), _any("no", "not", "nothing", "none", r"\w+n't", "lacks?", "missing", "insufficient", "empty", "silent", "fails?", "without", "irrelevant", "unrelated", "never", "too (?:thin|scarce|short|little|sparse|vague)", "cannot"), _any(r"answer\w*", "information", "question", "topic", r"mention\w*", r"address(?:es)?", r"help\w*", "useful", "relevant", "say", "says", "said", "needed", "details?", "about (?:this|it|that)", "clue", "enough", "empty", "thin", "scarce", "sparse", "vague", "silent", "irrelevant", "unrelated", "touch\\w*", "subject", "conclusion", "tell", "suitable", "insufficient")),
        # No information; an answer or the question is out of reach.
        r"(?<![\w'])(?:no|not enough|insufficient|too little|nothing|no (?:suitable|relevant|useful|reliable|further)) (?:[\w-]+ ){0,2}(?:information|data|context|material|evidence|answer|comment|details|knowledge|found|relevant|useful|suitable)(?!\w)(?=.*(?:answer|question|topic|found|available|this|given|conclu|respond|reply|comment|request|$))(?!.*\b(?:tax|return|deduction|taxpayer|declaration|payment|company|invoice)\b)",
        r"(?<![\w'])(?:unable|not able|impossible|not possible|not permitted|not allowed|not authori[sz]ed|cannot|can not|can't|could not|couldn't|not in a position) (?:to )?(?:[\w-]+ )?(?:answer|help|assist|advise|comment|respond|say|tell|discuss|give (?:an? |any )?(?:\w+ )?(?:advice|answer|opinion|guidance)|provide (?:an? |any )?(?:\w+ )?(?:advice|answer|opinion|guidance)|be answered|be discussed|be addressed here)(?!\w)",
        _near(_any("question", "topic", "request", "query", "subject", "matter", "that", "this", "it", "here"), _any(r"(?:outside|beyond|out of) (?:of )?(?:what|the scope|my|our|scope|the remit|the limits|the field)", "off limits", "out of scope", "cannot be (?:answered|discussed|addressed)", "can't be (?:answered|discussed|addressed)", "unanswered", "not something (?:i|we)", "no answer", "not covered here", "will not be answered", "not for me", "not mine")),
        r"(?<![\w'])(?:nothing (?:to (?:say|add|suggest|offer)|useful|relevant|suitable|(?:was )?found|helpful)|no comment|there is (?:no answer|nothing (?:here|to))|no answer (?:can|could|is|was|will))(?!\w)",
    )
]
# Some word of this kind stands in every refusal; sentences without are passed over.
_NEGATION = re.compile(
    r"(?<!\w)(?:не|нет|ни|нельзя|невозможно|без|вне|за|мало\w*|отсутств\w+|недостаточн\w*|нехватк\w+|пуст\w*|скуд\w+|слишком|отказ\w+|воздерж\w+|затрудн\w+|ничего|нечего|запрещено?|неизвестн\w+|недоступн\w+|вынужден\w*|предпочту|предпочитаю|промолчу|отклоняю|пас|умалчива\w+|молчат?|трудно|сложно|бессил\w+|бесполезн\w*|незнаком\w*|обрыва\w+)(?!\w)"
    r"|n't(?!\w)|(?<!\w)(?:no|not|nothing|none|nor|never|cannot|unable|impossible|lacks?|without|missing|insufficient|empty|silent|fails?|irrelevant|unrelated|too|refuse|declined?|refrain|regret|abstain|pass|outside|beyond|off|out|avoid|unanswered)(?!\w)"
)
# What makes a rule or a condition of a sentence, and what turns a reservation
# into an answer to come.
_CONDITION = re.compile(r"^(?:и |а |но )?(?:если|когда|в случае|при|чтобы|в том случае|if|when|where|unless|in case)(?!\w)")
RESERVE = re.compile(r"\b(?:однако|but the|however|зато)\b|\bно главное\b", re.I)
COURTESY = re.compile(
    r"^(?:(?:здравствуйте|добрый день|добрый вечер|спасибо(?: за (?:вопрос|обращение|понимание))?|к сожалению|увы|извините|простите|прошу прощения|приношу извинения|сожале\w+|честно говоря|hello|hi|dear user|good (?:day|afternoon)|thank you(?: for .*)?|thanks(?: for .*)?|sorry(?: about that)?|i am sorry|i'm sorry|my apologies|apologies|unfortunately|regrettably)[\s,.!:]*)+$"
    r"|^(?:лучше |просто )?(?:обратитесь|задайте|задать вопрос|уточните|попробуйте|переформулируйте|пожалуйста|проконсультируйтесь|рекомендую|советую|спросите|направьте|загляните|проверьте|воспользуйтесь|прошу|изложите|опишите|пришлите|добавьте|сформулируйте|свяжитесь|поищите)\b"
    r"|^(?:please|kindly|try|consult|consider|contact|ask|rephrase|perhaps|you (?:may|might|could|should) (?:want to |wish to )?(?:ask|contact|consult|try|rephrase|turn)|feel free|reach out|turn to)\b",
    re.I,
)
# Words that only frame a repeated question.
FRAME = frozenset("вопрос вопроса запрос пользователя пользователь вы вас спросили спрашивали спрашиваете ваш ваша итог ответ на звучит так your the question you asked user query request is was asks answer summary".split())

_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"|„[^“”]*[“”]")


def language(text: str) -> str | None:
    """The language most of the text is in, quotations aside; None if it cannot be told."""
    return languages.language(_QUOTED.sub(" ", _CITE.sub(" ", text)))


def is_empty(answer: str | None) -> bool:
    return answer is None or not _WORD.search(_CITE.sub(" ", answer))


def body(answer: str) -> str:
    """The answer without citation marks and reference lines at its end."""
    text = _BLANK.sub(" ", _CITE.sub(" ", answer)).strip()
    while True:
        cut = _TRAILER.sub("", text.rstrip(" ,;"))
        if cut == text.rstrip(" ,;") or not cut.strip():
            return text
        text = cut.rstrip()


def sentences(text: str) -> list[str]:
    return [s.strip(" -–—*•\t") for s in _SENTENCE.split(text) if _WORD.search(s)]


def declines(sentence: str) -> bool:
    """Whether a sentence says that no answer is given, rather than what the answer is."""
    text = " ".join(sentence.lower().replace("ё", "е").replace("’", "'").split())
    if len(text.split()) > LONGEST_REFUSAL or text.endswith("?") or not _NEGATION.search(text) or RESERVE.search(text) or _CONDITION.match(text):
        return False
    return any(p.search(text) for p in _REFUSALS)


def is_refusal(answer: str) -> bool:
    """Some sentence declines and every other one is a courtesy."""
    parts = sentences(_CITE.sub("", answer))
    seen = False
    for part in parts:
        if declines(part):
            seen = True
        elif not COURTESY.search(part):
            return False
    return seen


#: Bytes a Zstandard frame has whatever it holds.
FRAME_BYTES = 6


def _compressed(text: bytes, dictionary: bytes | None = None) -> int:
    """Bytes of the text, compressed alone or with a dictionary."""
    using = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return max(1, len(zstandard.ZstdCompressor(level=3, dict_data=using, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text)) - FRAME_BYTES)


def explained(text: list[str], by: list[str]) -> float:
    """How much of ``text`` a Zstandard dictionary of ``by`` spares: 0 nothing, 1 all."""
    plain, other = " ".join(text).encode(), " ".join(by).encode()
    if not plain or not other:
        return 0.0
    return 1.0 - _compressed(plain, other) / _compressed(plain)


def is_copy(question: str, answer: str) -> bool:
    """The answer is the question and nothing more.

    With the question as dictionary the answer must compress to little, and the question with
    the answer as dictionary too, else part of it is not there.  Each sentence of the answer,
    words that frame a question aside, must be made of the question's words: a sentence with
    others is substance, words changed, left out or put in within the question are not.
    """
    asked, text = _WORD.findall(question.lower()), _CITE.sub(" ", answer).lower()
    pool = set(asked)
    said = _WORD.findall(text)
    if len(asked) < 3 or not said or sum(w in pool for w in said) < 0.4 * len(said):
        return False
    if explained(said, asked) < COPY_SPARED or explained(asked, said) < COPY_SPARED:
        return False
    for part in sentences(text):
        words = [w for w in _WORD.findall(part) if w not in FRAME]
        new = [w for w in words if w not in pool]
        if len(new) > max(1, COPY_CHANGED * len(words)) or (len(words) <= 3 and new):
            return False
    return True


def _masked(word: str) -> str:
    return "#" if word.isdigit() else word.lower()


_STEP = re.compile(r"[^\W_]+|[.!?…\n]+|[^\w\s]+")


def terminal_contexts(text: str) -> Iterator[tuple[str, bool]]:
    """(last one or two words, whether a sentence ends there) for every word but the text's last."""
    steps = _STEP.findall(_BLANK.sub(" ", _CITE.sub(" ", text)))
    before = ""
    for step, after in zip(steps, steps[1:]):
        if not _WORD.match(step):
            if step[0] in ".!?…":
                before = ""
            continue
        word = _masked(step)
        ends = after[0] in ".!?…"
        yield word, ends
        if before:
            yield f"{before} {word}", ends
        before = word


def open_end(answer: str) -> tuple[str, str] | None:
    """None if the answer's last sentence has its stop; else its last word and last two words,
    or two empty strings where it stops at a comma or the like."""
    text = body(answer)
    if not text or _STOP.search(text):
        return None
    steps = _STEP.findall(text)
    if not _WORD.match(steps[-1]) and not re.match(r"[»”\"')\]*_%№]", steps[-1][-1]):
        return "", ""
    words = [_masked(w) for w in steps if _WORD.match(w)]
    return words[-1], " ".join(words[-2:])


#: Distinct endings of unfinished answers that are sent to every executor (some MB); more are
#: joined by key.
FEW_CONTEXTS = 100_000


def _context_counts(answers: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(context, ends, seen) over all answers, each id once; ``wanted``: only these contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for context, end in terminal_contexts(text):
                    if wanted is None or context in wanted:
                        n = rows.setdefault((key, context), [0, 0])
                        n[0] += end
                        n[1] += 1
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([rows[k][0] for k in keys], pa.int64()), pa.array([rows[k][1] for k in keys], pa.int64())], ["id", "context", "ends", "seen"])

    each = answers.mapInArrow(run, "id string, context string, ends bigint, seen bigint")
    # Rows that come twice are the same for their id and context, so they count once.
    once = each.groupBy("context", "id").agg(F.max(F.struct("seen", "ends")).alias("n"))
    return once.groupBy("context").agg(F.sum("n.ends").alias("ends"), F.sum("n.seen").alias("seen"))


def pair_defects(records: DataFrame) -> DataFrame:
    """(id, defect): one row for each defect of each record.

    ``records``: ``id, query, answer``; other columns are ignored.  A null id is no record.  A
    null or letterless answer is ``empty`` and nothing else.  With a null query only ``empty``,
    ``truncated`` and ``refusal`` can be told.  Repeated rows count once.  An empty table gives
    an empty result.  Texts are read where they lie: ids, marks and endings are shuffled.
    """
    spark = records.sparkSession
    tune_arrow(spark, 1000)
    use = with_columns(records, "id", "query", "answer").filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, query, answer in zip(*(c.to_pylist() for c in batch.columns)):
                if is_empty(answer):
                    out.append((key, "empty", None, None))
                    continue
                if is_refusal(answer):
                    out.append((key, "refusal", None, None))
                if query:
                    if is_copy(query, answer):
                        out.append((key, "copied_question", None, None))
                    a, b = language(query), language(answer)
                    if a and b and a != b:
                        out.append((key, "other_language", None, None))
                if tail := open_end(answer):
                    # One that stops at a comma or the like needs no look at other answers.
                    out.append((key, "truncated", None, None) if not tail[0] else (key, "unfinished", *tail))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "defect", "word", "words"])

    marked = durable(use.mapInArrow(run, "id string, defect string, word string, words string"), "marked")
    tails = marked.filter("defect = 'unfinished'")
    # Contexts are counted for the endings that occur, and each ending is judged once.
    endings = durable(tails.select("word", "words").distinct(), "endings")
    wanted = endings.select(F.explode(F.array("word", "words")).alias("context")).distinct()
    few = wanted.limit(FEW_CONTEXTS + 1).collect()
    counts = durable(_context_counts(use.select("id", "answer").filter("answer is not null"), {r[0] for r in few} if len(few) <= FEW_CONTEXTS else None), "contexts")
    one, two = counts.select(F.col("context").alias("word"), F.col("ends").alias("e1"), F.col("seen").alias("n1")), counts.select(F.col("context").alias("words"), F.col("ends").alias("e2"), F.col("seen").alias("n2"))
    often = F.when(F.coalesce("n2", F.lit(0)) >= 3, F.col("e2") / F.col("n2")).when(F.coalesce("n1", F.lit(0)) >= 3, F.col("e1") / F.col("n1")).otherwise(0.0)
    cut = endings.join(one, "word", "left").join(two, "words", "left").filter(often < ENDS_OFTEN).select("words")
    if len(few) <= FEW_CONTEXTS:
        cut = F.broadcast(cut)
    truncated = tails.join(cut, "words", "left_semi").select("id", F.lit("truncated").alias("defect"))
    return marked.filter("defect <> 'unfinished'").select("id", "defect").unionByName(truncated).distinct()
