"""Broken prompt and response pairs (problem 2).

Method: the response is compressed with its prompt as a zstandard dictionary to detect copies; dictionaries of function
words (languages) and of declining phrases (refusals) and a terminal-context model give the other labels. The model
counts, over all responses, how often each word ends a sentence or a closed part and how often it is followed by another
word; a response that ends without a closing mark, on a word that rarely ends anything, breaks off.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..skew import salted_join

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Texts that stand for nothing.
PLACEHOLDERS = frozenset("n/a na none null nil nan undefined unknown empty blank tbd todo - -- --- . .. ... … _ ? # x placeholder [empty] (empty) (none) [none] no response no answer no output keine keiner nada ninguno aucun aucune rien 无 无回答 空 暂无".split()) | frozenset(("no response", "no answer", "no output", "not available", "not applicable", "to be done"))

#: Parts of a tagged response.
TAGS = ("think", "rethink", "answer")

#: Frequent words of running text by language, none of them in two of the lists.
FUNCTION_WORDS = {
    "en": "the and of to is it in that with for which from this by but as be are was were has have had not its can so they when then together during would could should there their you your what how most some other more than into about looks because while who will",
    "es": "el los las del una unos y que por para con se su sus como más pero hay fue era está esta este estos estas muy también porque cuando donde hasta desde después antes hoy durante río junto ya qué cuál según al lo mira elige aparece es",
    "de": "der die das den dem des ein eine einer eines einem und ist nicht mit auf für von zu im am auch sich als wie aber oder bei nach vor war wird sind hat haben danach früher hier viel davon deshalb wegen zwischen durch über unter welcher sieh wähle dir warum liegt lang gibt gab nur kann sehen",
    "fr": "le les du une et est dans pour avec sur au aux ce cette ces qui ne pas plus mais ou où son sa ses il elle nous vous ils ont été était sont devant ensuite selon depuis pendant très même donc on cause à près beaucoup autrefois voit peine quel quelle regarde choisis",
    "it": "il gli della delle dello nel nella che è sono con non più anche perché questo questa quale pesce dopo sotto molto",
    "pt": "os da das dos não uma com mais também quando foi são peixe depois então você isso qual vídeo pelo pela",
    "nl": "het een van niet met zijn voor ook maar deze welke naar wordt werd heeft onder daarna vis omdat bij",
    "sv": "och att inte är på som för av till har jag ett här eftersom också från syns fisken var den",
    "da": "og ikke jeg fordi også være hvordan efter etter eller mellem hvor fisken kan ses",
    "pl": "nie jest się że przez oraz ale ponieważ który która ryba widać tego jako przy jej jego są",
    "cs": "není která které protože jsou při také jen ryba byla jako nebo jejich",
    "ro": "și este nu pentru din sunt acest această peștele deoarece într fi care",
    "tr": "ve bir bu için değil ile olarak çok daha ama çünkü balık gibi",
    "fi": "ei että kuin mutta myös kala koska joka ovat siinä tämä vain",
    "hu": "és nem egy hogy ezt mert csak hal volt vagy",
    "id": "dan yang ini tidak dengan untuk dari pada karena adalah ikan juga",
    "vi": "không của và là có những trong được cho một với cá này",
}
#: Scripts that tell a language, or a group of languages that a prompt in another script is not written in, and the characters that count as one word.
SCRIPTS = {"ja": ("\u3041-\u30ff", 2), "ko": ("\uac00-\ud7a3\u1100-\u11ff", 2), "zh": ("\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff", 2), "cyrillic": ("\u0400-\u052f", 5), "arabic": ("\u0600-\u06ff\u0750-\u077f", 4), "greek": ("\u0370-\u03ff\u1f00-\u1fff", 5), "hebrew": ("\u0590-\u05ff", 4), "thai": ("\u0e00-\u0e7f", 4), "devanagari": ("\u0900-\u097f", 4)}
#: Characters of a script from which on it tells something.
SCRIPT_LEAST = 8
#: What declines, and what is declined. A sentence declines if the parts of a pattern of DECLINES (between ``.*``) stand in it in their order, or if it matches CANNOT, TASKS and SPEAKER.
CANNOT = r"\b(?:can ?not|can ?['’]?t|could ?n['’]?t|unable|won ?['’]?t|will not|wouldn['’]?t|not (?:be )?(?:able|allowed|permitted|in a position|possible|appropriate|comfortable|going|willing|authori[sz]ed|equipped)|n['’]t (?:able|allowed|permitted|possible|feel comfortable|want|wish|have)|do not (?:feel|wish|want|have)|decline[sd]?|declining|refuse[sd]?|refusing|rather not|nobody should expect|no (?:way|means|access|opinion|answer|identification|species)|must (?:decline|refuse|pass)|have to (?:decline|refuse|pass)|prefer not|against|outside|beyond|unanswered|impossible|inappropriate|forbidden|prohibited|withhold|abstain|refrain|skip|pass on)\b"
TASKS = r"\b(?:identif\w+|naming|label(?:l?ing)?|name (?:the|this|that|it|a|any|an)\b[\w ]*|(?:give|provide|offer|state|supply|assign|determine|suggest|settle on) (?:you )?(?:a|an|any|the|this|that|my)?\b ?(?:\w+ ){0,2}(?:species|answer|identification|opinion|name|verdict|judg\w+|option|information)|species|answer(?:s|ed|ing)?|question|assist\w*|help(?:ing)?|comply|comment|options?|choose|choice|request|task|judge (?:this|the|that) (?:recording|footage|clip|video|material|animal|fish)|(?:work|deal) with (?:video|the|this|that|footage|clips?)\b|anal[yv][sz]\w*|(?:view|watch|open|see|access|process|look at|inspect|review) (?:the |this |that |any |these )?(?:videos?|clips?|footage|recordings?|material|files?|images?|media)|do (?:that|this|so)|remit|scope|rules?|guidelines?|polic(?:y|ies)|footage like|service|opinion|classif\w+|discuss\w*|respond|continue|proceed)\b"
DECLINES = (
    r"\b(?:guidelines?|rules?|polic(?:y|ies)|instructions|terms|safety|programming) (?:[\w]+ ){0,4}(?:(?:not|\w+n['’]t) (?:\w+ )?(?:let|allow|permit|support|cover|extend|include|enable|authori[sz]e|want|leave|give)|forbid|prohibit|prevent|prohibits|forbids|prevents|against)",
    r"\b(?:against|violates?|breaks?) (?:the|my|our|its) (?:rules?|guidelines?|polic\w+|principles)",
    r"\boutside (?:of )?(?:my|our|the|what i)\b", r"\bbeyond (?:my|what i)\b", r"\bfalls? (?:outside|beyond)\b", r"\b(?:has|have|needs?|will have) to (?:stay|remain|go) unanswered\b", r"\bnot a service\b", r"^declined\b", r"\bi (?:must|have to|shall|will|would|am going to|need to)? ?(?:respectfully |politely )?(?:decline|refuse|pass)\b",
    r"\bno (?:video|clip|footage|recording|file|image|media|attachment) (?:reached|was (?:attached|provided|received|given)|arrived|came|is (?:attached|available))", r"\b(?:text|language)[- ](?:only|based|model)\b", r"\bas an? (?:ai|assistant|language|text)\b", r"\bno opinion\b", r"\bask (?:me )?(?:something|for something) else\b", r"\bi(?: am|['’]m) (?:sorry|afraid)[ ,].*\b(?:can|could|will|not|n['’]t|unable)", r"\bplease (?:consult|ask|contact)\b", r"\bi do not have access\b", r"\bnot for me to (?:say|decide|judge)\b",
    # Spanish, German, French, Italian, Portuguese
    r"\bno (?:me es posible|es posible|puedo|podemos|estoy (?:autorizad\w|en condiciones)|se me permite|dispongo|tengo (?:acceso|permiso)|voy a|quiero|debo)\b.*\b(?:ayud\w+|analizar|identificar|responder|respuesta|contestar|solicitud|v[ií]deo|pregunta|especie|opinar|nombrar|decir|ver|material|grabaci[oó]n|dar|ofrecer|indicar)", r"\blo siento\b.*\b(?:no|imposible)\b", r"\b(?:prefiero no|me niego|debo rechazar|declino|rehuso|consulte a)\b",
    r"\b(?:kann|darf|möchte|werde|will|könnte|konnte) (?:ich )?.*\b(?:nicht|keine?n?)\b.*\b(?:helfen|beantworten|bestimmen|sagen|nennen|auskunft|analysieren|ansehen|geben|antwort\w*|einschätz\w+|art|video|anfrage|frage)\b", r"\bich (?:kann|darf|möchte|werde|will)(?: [\w-]+){0,8} (?:nicht|keine?n?)\b(?! (?:[\w-]+ ){0,3}(?:sehen|erkennen|ausmachen|unterscheiden|zählen|messen))", r"\b(?:möchte|will|werde|kann|darf|werden) (?:ich |wir )?(?:mich|uns)\b.*\bnicht\b.*\b(?:äußern|festlegen|einlassen|befassen)\b", r"\b(?:kann|darf|möchte|werde|will|könnte) ich\b.*\b(?:nicht|nichts|keine?n?)\b.*\b(?:sagen|beantworten|antworten|nennen|geben|helfen|bestimmen|mitteilen|angeben|preisgeben)\b", r"\b(?:gebe|erteile|mache) ich\b.*\bkeine?n?\b", r"\bich bin (?:\w+ )?(?:nicht|keine?) (?:dafür|dazu|befugt|berechtigt|zuständig|der richtige)\b", r"\b(?:tut mir leid|leider|bedaure|bedauere|entschuldig\w+)\b.*\b(?:nicht|keine?n?|unmöglich)\b", r"\bkeine auskunft\b", r"\b(?:muss|möchte) (?:ich )?(?:das |dies |die anfrage )?ablehnen\b", r"\bes ist mir nicht (?:möglich|erlaubt)\b", r"\blehne (?:ich )?.*\bab\b",
    r"\bje (?:ne |n['’])(?:peux|puis|suis|saurais|souhaite|veux|dispose|ai)\b.*\b(?:pas|aucun\w*)\b", r"\bil (?:ne )?m['’]est (?:pas possible|impossible)\b", r"\bd[ée]sol[ée]e?\b.*\b(?:pas|impossible|aucun\w*)\b", r"\b(?:je (?:refuse|dois refuser|pr[ée]f[èe]re ne pas|d[ée]cline)|impossible (?:pour moi )?d['’e])", r"\bje regrette\b", r"\bne (?:me )?permet(?:tent)? pas\b", r"\bconsulte[zr] un\b",
    r"\bnon (?:posso|sono in grado|mi è possibile)\b", r"\bn[ãa]o (?:posso|me é possível|consigo|estou autorizad\w)\b",
    # English, further
    r"\b(?:something|questions?|topics?|requests?|matters?)\b.*\b(?:i|we) (?:stay away from|keep out of|do not touch|don['’]t touch|avoid)\b", r"\bnot be (?:right|proper|fitting|appropriate|fair|wise) (?:for me|of me)\b", r"\b(?:stops?|keeps?|prevents?|bars?|prohibits?|forbids?) me (?:from|to)\b", r"\bi(?:['’]m| am) (?:declining|refusing|abstaining|passing|opting out)\b", r"\bno (?:determination|classification|judg\w+|assessment|statement) (?:can|will|could|may|shall) be\b", r"\bnot (?:permitted|allowed|authori[sz]ed|able|free|meant|supposed) to (?:say|tell|name|reveal|share|state|comment|answer)\b",
    r"\b(?:i|we) (?:do not|don['’]t|never|may not|must not|should not|am not to|are not to|(?:have|has) been (?:told|asked|instructed) not to|(?:was|were|am|are) (?:told|asked|instructed) not to) (?:\w+ ){0,2}(?:name|identify|label|classify|answer|comment|discuss|assist|help|offer|give|provide|judge|speculate)\b", r"\b(?:will|shall|must|have to|would rather) (?:\w+ )?leave (?:it|this|that) (?:there|here|open|unanswered|to|for)\b", r"\bleave (?:it |this |that )?(?:for|to) (?:an?|the|someone|somebody|others) (?:\w+ )?(?:biologist|expert|specialist|person|human|professional|authority)?", r"\bnot (?:offered|provided|available|given|done) (?:by me|here|through me)\b", r"\boverstep(?:ping)?\b", r"\b(?:no|not a|not any) (?:species|answer|name|label|verdict|identification|opinion)s?\b.*\bfrom (?:me|us)\b",
    r"\b(?:let us|let['’]s|can we|we could) talk about something (?:else|different)\b", r"\b(?:find|ask|try|consult) (?:someone|somebody|anyone|another|a different) (?:else|person|expert|source|tool)?\b", r"\boff the table for (?:me|us)\b", r"\bnot (?:my|our) (?:job|role|task|place|business|call|remit)\b", r"\bi (?:will|would|shall|can)(?: not|not|n['’]t) (?:\w+ ){0,4}(?:be drawn|be pressed|put a (?:label|name)|label|name|take (?:this|that|it) on|weigh in|go there|venture)\b", r"\bnot one i (?:take|answer|handle|deal)\b", r"\bthis is where i stop\b",
    r"\bi(?:['’]d| would) (?:rather|prefer|sooner) (?:not|to (?:pass|skip|leave|sit))\b", r"\bsit(?:ting)? this (?:one )?out\b", r"\b(?:count|leave) me out\b", r"\bno comment\b", r"\bnot something (?:that )?i (?:can|could|will|may|do|am|should)\b", r"\bi (?:lack|have no|do not have|don['’]t have|am without) (?:the |any )?(?:ability|means|access|permission|authori[sz]ation|capacity|tools|right|mandate)\b",
    r"\b(?:request|question|query)\b.*\b(?:denied|declined|rejected|refused|not be (?:answered|processed|granted|fulfilled))\b", r"\bi(?:['’]ll| will| shall| must| have to| need to) (?:\w+ )?(?:abstain|refrain|withhold|turn (?:this|that|it) down|say no|leave (?:this|that|it) (?:open|unanswered|to ))", r"\bnot (?:at liberty|my place|in my power)\b", r"\bi(?:['’]m| am) not (?:the (?:right )?one|willing|prepared|going to|at liberty|authori[sz]ed|the right)\b", r"\b(?:cannot|can['’]t|can not|won['’]t|unable to|refuse to|not going to) (?:\w+ ){0,2}(?:help|assist|answer|respond|comply|oblige|do (?:this|that|it|so))\b",
    # Spanish, German, French, Italian, Portuguese, Dutch, Swedish, Danish, Polish, Russian, Turkish, Arabic, further
    r"\b(?:me abstengo|rechazo (?:la|esta|responder|dar)|no (?:me corresponde|voy a|daré|responderé|contestaré|procede|estoy en posición)|lamento no (?:poder|ser)|me temo que no|imposible (?:ayudar|responder|contestar|atender))\b", r"\bprefiero (?:abstenerme|callar|no)\b", r"\b(?:petición|solicitud|pregunta)\b.*\bfuera de (?:lo que|mi|mis)\b", r"\bme es imposible\b", r"\bno tengo (?:autorización|permiso|autoridad|manera|forma)\b", r"\bn[ãa]o me é (?:permitido|possível)\b", r"\bno se me (?:ha |han )?(?:autoriza\w*|permit\w+|conced\w+)\b", r"\bno (?:quiero|deseo|pienso|debo) (?:pronunciarme|opinar|responder|contestar|nombrar|identificar|decir)\b", r"\b(?:nicht|außer) (?:in der lage|stande|imstande|befugt|berechtigt)\b", r"\b(?:verweigere|enthalte) (?:ich )?(?:mich|die|eine|jede|diese)?", r"\bich (?:verweigere|enthalte|lehne|passe|muss passen|äußere mich nicht|gebe keine|sage (?:dazu )?nichts|beantworte (?:das|dies|diese frage) nicht)\b", r"\bdazu (?:sage|äußere|gebe) ich\b.*\b(?:nicht|nichts|keine?)\b", r"\bsteht mir nicht zu\b", r"\b(?:zurückweisen|zurückzuweisen|abweisen|ausschlagen)\b", r"\b(?:ist|wurde) mir (?:\w+ )?(?:untersagt|verboten|nicht gestattet)\b",
    r"\b(?:je (?:m['’]abstiens|dois m['’]abstenir|ne (?:répondrai|donnerai|dirai|ferai) pas|passe mon tour)|il m['’]est interdit|pas en mesure d|hors de (?:mes|ma) (?:compétences?|portée))", r"\b(?:demande|question)\b.*\b(?:dépasse|excède|sort de) (?:ce que|mes|mon|ma)\b", r"\b(?:contraint\w*|obligé\w*|tenu\w*) de (?:refuser|décliner)\b", r"\bne relève pas de (?:mes|mon|ma)\b", r"\bje ne (?:peux|puis|saurais) (?:pas |rien )?(?:vous |y |en )?(?:répondre|aider|identifier|nommer|dire|donner|fournir|traiter)\b", r"\bje n['’]ai (?:pas|aucun\w*) (?:le droit|l['’]autorisation|la permission|la possibilité)\b", r"\bnon sono (?:autorizzat\w|abilitat\w|tenut\w|disposto)\b", r"\b(?:mi dispiace|purtroppo|spiacente)\b.*\bnon\b", r"\b(?:mi rifiuto|preferisco non|non intendo|mi astengo|devo (?:rifiutare|declinare)|non (?:rispondo|risponderò|darò|posso))\b", r"\b(?:desculpe|lamento|infelizmente|sinto muito)\b.*\b(?:não|impossível)\b", r"\b(?:recuso|prefiro não|não (?:vou|irei|responderei|darei|quero)|me abstenho|abstenho-me)\b",
    r"\b(?:helaas|sorry|het spijt me)\b.*\b(?:niet|geen)\b", r"\bik (?:weiger|kan|mag|wil|zal|ga|geef)\b.*\b(?:niet|geen)\b.*\b(?:helpen|beantwoorden|geven|zeggen|antwoord\w*|benoemen|bepalen|beoordelen|bekijken)\b", r"\bik weiger\b", r"\b(?:kan|mag|wil|zal) ik\b.*\b(?:niet|geen)\b.*\b(?:helpen|beantwoorden|geven|zeggen|benoemen|bepalen|beoordelen|bekijken)\b", r"\b(?:tyvärr|ledsen|beklager|desværre|dessverre)\b.*\b(?:inte|ikke|ingen|inget)\b", r"\b(?:jag|jeg) (?:kan|vill|vil|får|kommer)\b.*\b(?:inte|ikke)\b.*\b(?:hjälpa|svara|hjælpe|hjelpe|svare|ange|avgöra|namnge|nævne|navngi|säga|sige|si|identifier\w+|bestämma)\b", r"\b(?:jag avstår|vägrar|avböjer|afslår|avslår|nægter|nekter)\b", r"\bnie (?:mogę|jestem w stanie|będę|chcę|wolno mi|podam)\b.*\b(?:pomóc|odpowie\w+|zidentyfikować|określić|podać|ocenić|nazwać|rozpoznać)\b", r"\b(?:odmawiam|niestety nie)\b",
    r"(?:извините|простите|к сожалению|сожалею).*(?:не|нельзя)\b", r"\bя (?:не (?:могу|буду|стану|имею права|вправе|в состоянии)|отказываюсь|вынужден\w* отказ\w+|воздержусь)", r"\bне (?:скажу|отвечу|назову|дам ответа?|комментирую)\b", r"\bмне (?:запрещено|нельзя|не (?:разрешено|положено|дозволено))\b", r"\b(?:üzgünüm|maalesef|özür)\b.*\b\w+(?:amam|emem|mıyorum|miyorum|muyorum|müyorum|maz|mez)\b", r"\b(?:cevap|yanıt|yardım|bilgi|isim|tür)\w*\b.*\b\w+(?:amam|emem|mıyorum|miyorum)\b", r"\b(?:reddediyorum|cevaplayamam|yardımcı olamam|yanıtlayamam)\b", r"(?:آسف|عذر|للأسف|أعتذر).*(?:لا|لن|عن|غير)", r"(?:لا (?:أستطيع|يمكنني|أقدر|يحق لي)|لن أ|أرفض|أمتنع)",
    # Japanese, Korean
    r"(?:控え|遠慮|辞退)(?:させ|いた|し(?:ます|て))",
    r"(?:申し訳|すみません|ごめん|恐れ入り|残念).*(?:ません|できない|かねます|ない)", r"(?:答え|回答|お答え|判断|特定|識別|お手伝い|対応|提供|コメント)[^。]{0,8}(?:できません|できかね|いたしかね|しかね|差し控え|控え|致しかね|お断り|拒否|ありません)", r"お断り(?:し|いた|します|させ)", r"(?:죄송|미안|유감|안타깝).*(?:없|않|못|어렵)", r"(?:답변|대답|도와|도움|식별|확인|판단|말씀|제공|분석)[^.]{0,10}(?:수 없|드릴 수 없|않겠|거부|거절|어렵|못)",
    # Chinese
    r"(?:不予|拒绝|恕不|无法)(?:回答|置评|作答|评论|奉告|回复)", r"不(?:在|属于)我的[^。]{0,6}(?:范围|职责|能力)|无可奉告|爱莫能助|恕难|不方便(?:透露|回答|说)|没有(?:资格|权限|权利)|超出(?:了)?我的(?:能力|职责|范围|权限)|难以(?:作答|回答)|不便(?:作答|回答|透露)", r"(?:抱歉|对不起|很遗憾|遗憾|不好意思|恕).*(?:不|无法|未能|难以)", r"(?:我|本人|本助手|作为)[^。！？]{0,8}(?:不能|无法|不便|不可以|不会|不愿|拒绝|没有办法|没法|未获)[^。！？]*(?:查看|观看|回答|提供|判断|协助|帮助|识别|鉴定|分析|给出|处理|评论|辨认|说明|选择)", r"(?:无法|不能|拒绝)(?:回答|协助|帮助|提供|处理|查看|观看)", r"请(?:咨询|询问)",
)
#: Whose inability it is: that of the speaker or of the request, not of a fish or a camera.
SPEAKER = r"\b(?:i|me|my|we|us|our|as an?|this (?:assistant|model|system|service|tool|request|question|one)|that (?:request|question)|the (?:request|question)|requests?|not possible|impossible|declined|sorry|unfortunately|regret\w*|clips?|videos?|service|nobody|identification)\b|['’]m\b"
#: Remarks about single things that cannot be seen; they decline nothing.
REMARKS = r"\b(?:yet|although|though|rely on|clear enough|changes little|set aside|cannot be settled by|counts? for less|can be ruled|is fairly safe|rest of)\b|\b(?:make out|judge|see|tell|read|settle) (?:the|every|all|its|any) (?:\w+ )?(?:fins?|whiskers?|belly|colou?rs?|tail|eyes?|gills?|mouth|scales?|body|spots?|stripes?|back|head|flank|barbels?|pattern|outline)\b"
#: Marks that close a sentence, quotes and brackets that may follow them, and marks that never end a text.
CLOSERS, QUOTES = ".!?。！？؟", "\"'”’»)]}）】」』›*_"
# -------------------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"<\s*(/?)\s*(" + "|".join(TAGS) + r")\s*>", re.I)
_ANY_TAG = re.compile(r"</?\s*[A-Za-z][\w-]*\s*/?>")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|_+")
_SCRIPTS = {name: (re.compile(f"[{chars}]"), size) for name, (chars, size) in SCRIPTS.items()}
_DECLINES = [[re.compile(part, re.I | re.S) for part in p.split(".*")] for p in DECLINES]
_LATIN_DECLINES = [parts for p, parts in zip(DECLINES, _DECLINES) if re.search("[A-Za-z]", re.sub(r"\\.", "", p))]
_HIDDEN = re.compile("[" + "".join(re.escape(chr(i)) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Cf", "Cc") and not chr(i).isspace()) + "]")
_CANNOT, _TASKS, _SPEAKER, _REMARKS = (re.compile(p, re.I) for p in (CANNOT, TASKS, SPEAKER, REMARKS))
_LANGUAGE_OF = {word: language for language, words in FUNCTION_WORDS.items() for word in words.split()}
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=[^\s.!?。！？])|\n+")
_LETTERS = re.compile(r"[^\W\d_]+")
_OPTION = re.compile(r"\(([A-Za-z])\)\s*([^\n(]*)")


@lru_cache(maxsize=64)
def bare(text: str | None) -> str:
    """Without tags, invisible characters and surplus blanks."""
    plain = text or ""
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain)
    if "<" in plain:
        plain = _ANY_TAG.sub(" ", plain)
    plain = " ".join(plain.split())
    return plain if plain.isprintable() else " ".join(_HIDDEN.sub("", plain).split())


def is_nothing(text: str | None) -> bool:
    plain = bare(text).lower()
    return plain in PLACEHOLDERS or not re.search(r"\w", plain.replace("_", ""))


def folded(text: str | None) -> str:
    return " ".join(_WORD.findall(bare(text))).lower()


#: Level of compression.
LEVEL = 3


class Copies:
    """Whether a text is its prompt again and nothing else."""

    def __init__(self, ratio: float = 0.30, kept: float = 0.75):
        self.ratio, self.kept = ratio, kept
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def new_share(self, prompt: str, response: str) -> float:
        """Bytes that the response takes beside the prompt, as a share of what it takes alone."""
        if not prompt or not response:
            return 1.0
        response_bytes = response.encode()
        empty = len(self.plain.compress(b""))
        alone = len(self.plain.compress(response_bytes)) - empty
        with_prompt = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(prompt.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return max(0, len(with_prompt.compress(response_bytes)) - empty) / max(alone, 1)

    def __call__(self, prompt: str, response: str, options: frozenset[str]) -> bool:
        prompt, response = folded(prompt), folded(response)
        if not response or response in options:
            return False
        if self.new_share(prompt, response) > self.ratio + 6 / len(response) ** 0.5:
            return False
        have, want = response.split(), prompt.split()
        return common_words(have, want) >= self.kept * len(have) and len(have) >= 3


def common_words(have: list[str], want: list[str]) -> int:
    """How many words of ``have`` stand in ``want`` in the same order (longest common subsequence), by rows of bits."""
    places: dict[str, int] = defaultdict(int)
    for i, word in enumerate(want):
        places[word] |= 1 << i
    whole = (1 << len(want)) - 1
    row = whole
    for word in have:
        if hits := row & places.get(word, 0):
            row = (row + hits | row - hits) & whole
    return len(want) - row.bit_count()


def language(text: str, least: int = 3) -> str | None:
    """The language of running text (for some scripts the script), or None if too little of it tells. Names of species in any language tell nothing when they stand alone."""
    plain = bare(text)
    counts: dict[str, int] = defaultdict(int)
    for word in _LETTERS.findall(plain.lower()):
        if found := _LANGUAGE_OF.get(word):
            counts[found] += 1
    if not plain.isascii():
        signs = {name: len(pattern.findall(plain)) for name, (pattern, _) in _SCRIPTS.items()}
        if signs["ja"] * 8 >= signs["ja"] + signs["zh"]:  # Japanese is written with Chinese characters too
            signs["ja"], signs["zh"] = signs["ja"] + signs["zh"] if signs["ja"] else 0, 0
        for name, n in signs.items():
            if n >= SCRIPT_LEAST:
                counts[name] += n // _SCRIPTS[name][1]
    if not counts:
        return None
    best = max(counts, key=counts.get)
    return best if counts[best] >= least and counts[best] * 10 >= 6 * sum(counts.values()) else None


def _stand_in_order(parts: list[re.Pattern], sentence: str) -> bool:
    """Whether each part is found behind the one before it; linear in the sentence, however long."""
    at = 0
    for part in parts:
        found = part.search(sentence, at)
        if not found:
            return False
        at = found.end()
    return True


def declines(text: str) -> bool:
    """Whether a sentence of the text declines to answer."""
    return any(sentence and _declines(sentence) for sentence in _SENTENCE.split(bare_lines(text)))


@lru_cache(maxsize=1 << 14)
def _declines(sentence: str) -> bool:
    if _REMARKS.search(sentence):
        return False
    patterns = _LATIN_DECLINES if sentence.isascii() else _DECLINES
    return any(_stand_in_order(p, sentence) for p in patterns) or bool(_CANNOT.search(sentence) and _TASKS.search(sentence) and _SPEAKER.search(sentence))


def bare_lines(text: str) -> str:
    return "\n".join(bare(line) for line in re.split(r"[\n\r]+", _TAG.sub("\n", text)))


def tag_state(text: str) -> tuple[bool, bool]:
    """(some tag is open at the end or cut off, some part is tagged)."""
    open_tags: list[str] = []
    last = 0
    for match in _TAG.finditer(text):
        last = match.end()
        if not match.group(1):
            open_tags.append(match.group(2).lower())
        elif match.group(2).lower() in open_tags:
            while open_tags.pop() != match.group(2).lower():
                pass
    tail = re.search(r"<\s*/?\s*[A-Za-z]*\s*$", text[last:])
    cut = bool(tail) and any(tag.startswith(re.sub(r"[^a-z]", "", tail.group().lower())) for tag in TAGS)
    return bool(open_tags) or cut, last > 0


def tokens(text: str) -> list[str]:
    """Words, numbers (all as 9), single Chinese characters and marks."""
    out = []
    for m in re.finditer(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]", text.lower()):
        t = m.group()
        out.append("9" if t[0].isdigit() else t)
    return out


def is_word(token: str) -> bool:
    return token[0].isalnum()


def last_mark(text: str) -> tuple[str, str]:
    """(``closed`` | ``open`` | ``word``, last word with the token before it): how a text ends."""
    plain = bare(text).rstrip()
    if re.search(r"\w\s*(?:\.{3,}|…)$", plain):
        return "open", ""
    plain = plain.rstrip(QUOTES + " ") or plain
    if not plain:
        return "closed", ""
    if plain[-1] in CLOSERS:
        return "closed", ""
    found = tokens(plain)
    if not found:
        return "closed", ""
    return ("word", " ".join(["", *found][-2:])) if is_word(found[-1]) else ("open", "")


def word_ends(parts: list[str]) -> dict[str, list[int]]:
    """word, and word with the token before it -> [times it ends a sentence or a closed part, times another word follows]."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for part in parts:
        found = tokens(bare(part))
        for before, word, after in zip(["", *found], found, [*found[1:], "."]):
            if is_word(word) and (after in CLOSERS or is_word(after)):
                for context in (word, f"{before} {word}"):
                    counts[context][0 if after in CLOSERS else 1] += 1
    return counts


def closed_parts(text: str) -> list[str]:
    """The insides of closed tags of a response; of an untagged one, its sentences but the last."""
    inside = re.findall(r"<(think|rethink|answer)>(.*?)</\1>", text, re.I | re.S)
    if inside:
        return [part for _, part in inside]
    sentences = _SENTENCE.split(text)
    return sentences[:-1] if len(sentences) > 1 else []


#: A part of so few words is a bare option.
BARE_WORDS = 3


class Judge:
    """Labels one pair. Where the text ends on a word without a mark, the terminal-context model may still call it truncated."""

    def __init__(self):
        self.copies = Copies()

    def __call__(self, prompt: str | None, fields: list[str | None], tagged: bool) -> tuple[str | None, str | None]:
        """(defect, last words if the text ends on them unmarked). ``fields``: the parts of a response in their order."""
        parts = [f for f in fields if f is not None and not is_nothing(f)]
        if not parts:
            return "empty", None
        whole = "\n".join(parts)
        options = frozenset(x for letter, name in _OPTION.findall(prompt or "") for x in (folded(name), folded(f"{letter} {name}")))
        pieces = self.pieces(parts) if tagged else parts
        if not pieces:
            open_tag, _ = tag_state(whole)
            return ("truncated" if open_tag and re.search(r"\w", bare(whole)) else "empty"), None
        if not is_nothing(prompt) and all(self.copies(prompt, piece, options) for piece in dict.fromkeys(pieces)):
            return "copy", None
        if tagged and tag_state(parts[-1])[0]:
            return "truncated", None
        rest = self.rest(prompt, whole, options, pieces)
        if tagged and self.answer_missing(whole) and rest is None:
            rest = "empty"
        kind, word = last_mark(pieces[-1])
        if kind == "open":
            return "truncated", None
        if kind == "word" and len(folded(pieces[-1]).split()) > BARE_WORDS:
            return rest, word
        return rest, None

    @staticmethod
    def pieces(parts: list[str]) -> list[str]:
        return [piece for part in parts for piece in _TAG.split(part)[::3] if not is_nothing(piece)]

    @staticmethod
    def answer_missing(whole: str) -> bool:
        return any(is_nothing(part) for tag, part in re.findall(r"<(answer)>(.*?)</answer>", whole, re.I | re.S))

    @staticmethod
    def rest(prompt: str | None, whole: str, options: frozenset[str], pieces: list[str]) -> str | None:
        named = any(o and re.search(rf"\b{re.escape(o)}\b", folded(whole)) for o in options) or bool(re.search(r"\([A-Ja-j]\)", whole))
        if not named and declines(whole):
            return "refusal"
        asked = language(re.sub(r"\([A-Z]\)[^\n]*", " ", prompt or ""), 2)
        given = language("\n".join(p for p in pieces if folded(p) not in options))
        return "other_language" if asked and given and asked != given else None


# ---- on tables ----------------------------------------------------------------------------------------------------

PAIR_KEYS = ("record_table", "record_id")


def res_pairs(res: DataFrame) -> DataFrame:
    """(record_table, record_id, prompt, fields, tagged) of res; the prediction stands for an output that is null or blank. Rows with an error are left out."""
    fine = res.where("error IS NULL OR trim(error) = ''")
    output = F.when(F.coalesce(F.trim("model_raw_output"), F.lit("")) == "", F.col("prediction")).otherwise(F.col("model_raw_output"))
    return fine.select(F.lit("res").alias("record_table"), F.col("result_id").cast("long").alias("record_id"), F.col("question").alias("prompt"), F.array(output).alias("fields"), F.lit(True).alias("tagged"))


#: Text fields of an annotation in their order.
ANNOTATION_FIELDS = ("supporting_reasoning", "exclusion_counterfactual", "uncertainty reasoning", "summary")


def stage2_pairs(stage2: DataFrame) -> DataFrame:
    """The same of stage2_cot, the response being the annotation's text fields."""
    fine = stage2.where("error IS NULL OR trim(error) = ''")
    fields = F.array(*(F.col(f"rethink_annotation.`{name}`") for name in ANNOTATION_FIELDS))
    return fine.select(F.lit("stage2_cot").alias("record_table"), F.col("record_id").cast("long").alias("record_id"), F.col("rethink_prompt").alias("prompt"), fields.alias("fields"), F.lit(False).alias("tagged"))


def terminal_counts(pairs: DataFrame) -> DataFrame:
    """(word, ends, goes_on) over all responses; counted in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for fields, tagged in zip(batch.column("fields").to_pylist(), batch.column("tagged").to_pylist()):
                texts = [f for f in fields or [] if f]
                parts = [p for t in texts for p in closed_parts(t)] if tagged else texts[:-1]
                for word, (ends, more) in word_ends(parts).items():
                    total[word][0] += ends
                    total[word][1] += more
            yield pa.RecordBatch.from_pydict({"word": list(total), "ends": [v[0] for v in total.values()], "goes_on": [v[1] for v in total.values()]}, schema=pa.schema([("word", pa.string()), ("ends", pa.int64()), ("goes_on", pa.int64())]))

    counted = pairs.select("fields", "tagged").mapInArrow(count, "word string, ends long, goes_on long")
    return counted.groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def judged(pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, defect, word): the labels that a pair alone gives, and the word on which it ends unmarked."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            found = []
            for prompt, fields, tagged in zip(batch.column("prompt").to_pylist(), batch.column("fields").to_pylist(), batch.column("tagged").to_pylist()):
                pair = (prompt, tuple(fields or ()), tagged)
                if pair not in seen:
                    seen[pair] = judge(prompt, fields or [], tagged)
                found.append(seen[pair])
            yield pa.RecordBatch.from_arrays([batch.column("record_table"), batch.column("record_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["record_table", "record_id", "defect", "word"])

    return pairs.mapInArrow(label, "record_table string, record_id long, defect string, word string")


#: A word ends a text if it did so in at least this share of its places.
END_SHARE, END_PRIOR = 0.2, 0.1
#: Places from which on the word and the one before it are asked, not the word alone.
PAIR_LEAST = 3


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, defect) of every defective pair, one defect each.

    The first that holds of: empty (nothing, blanks, empty tags, placeholders), copy, truncated (a tag is open, or the
    text ends on an open mark or on a word that rarely ends), refusal (no species or option named), other_language (than
    the prompt's; only where both can be told). Null prompts can be neither copied nor in another language.
    """
    first = cut_lineage(judged(pairs))
    unmarked = first.where("word IS NOT NULL")
    counts = cut_lineage(terminal_counts(pairs))
    pair = salted_join(unmarked, counts, "word", F.col("record_id"), "left").withColumnsRenamed({"ends": "pair_ends", "goes_on": "pair_goes_on"})
    both = salted_join(pair.withColumn("word", F.substring_index("word", " ", -1)), counts, "word", F.col("record_id"), "left")
    ends, goes_on = (F.when(F.col("pair_ends") + F.col("pair_goes_on") >= PAIR_LEAST, F.col(f"pair_{c}")).otherwise(F.coalesce(c, F.lit(0))) for c in ("ends", "goes_on"))
    share = (ends + END_PRIOR) / (ends + goes_on + 1)
    decided = both.select(*PAIR_KEYS, F.when(share < END_SHARE, F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
    return first.where("word IS NULL").select(*PAIR_KEYS, "defect").unionByName(decided).where("defect IS NOT NULL")


def defect_report(res: DataFrame, stage2: DataFrame) -> DataFrame:
    """Pairs by table and defect."""
    return found(res, stage2).groupBy("record_table", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def found(res: DataFrame, stage2: DataFrame) -> DataFrame:
    """(record_table, record_id, defect) of p2_found."""
    return broken_pairs(res_pairs(res).unionByName(stage2_pairs(stage2)))
