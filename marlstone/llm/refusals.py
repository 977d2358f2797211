"""Refusals: clauses aligned with templates whose places are word classes.

A template is a row of places, each a class of words that can stand there: who speaks,
whether it is denied, what would be done. A clause follows a template if its words, in
order and with few words between, fill every place. Contractions are written out first,
so that "can't", "cannot" and "can not" are one. Templates name no sentence: any wording
that fills the places counts, in seven languages.
"""

from __future__ import annotations

import re

_CLAUSE = re.compile(r"[.!?;:](?=\s|$)|\n")
_WORD = re.compile(r"[^\W\d_]+'?|,")
#: Words between two filled places.
GAP = 3

_CONTRACTIONS = (
    (re.compile(r"\bcan't\b|\bcannot\b"), "can not"), (re.compile(r"\bwon't\b"), "will not"), (re.compile(r"\bshan't\b"), "shall not"), (re.compile(r"n't\b"), " not"),
    (re.compile(r"\bi'm\b"), "i am"), (re.compile(r"'d\b"), " would"), (re.compile(r"'ll\b"), " will"), (re.compile(r"'re\b"), " are"), (re.compile(r"'ve\b"), " have"),
)

# fixed values: word classes
_C = {
    "I": "i we", "ME": "me us my our", "MY": "my our",
    "MODAL": "can could will would may do did am are shall should must might",
    "NOT": "not never neither no",
    "ABLE": "able unable possible permitted allowed authorised authorized position equipped qualified supposed free prepared willing going comfortable",
    "UNABLE": "unable impossible unwilling forbidden prohibited barred",
    "SELF": "i", "DECLINE": "decline refuse refrain abstain demur",
    "RATHER": "rather prefer choose opt elect wish like want care",
    "SKIP": "not skip pass leave avoid refrain abstain omit",
    "DO": "answer answering help helping assist assisting provide providing give giving say saying tell telling respond responding reply replying comply complying solve solving share sharing discuss comment offer treat handle address attempt attempting complete fulfil fulfill disclose reveal state verify determine advise resolve tackle work serve process engage",
    "IT": "this that it these question questions problem request task answer answers one you here anything prompt query matter topic theorem exercise",
    "LACK": "lack miss", "HAVE": "have know possess see hold", "NEED": "answer answers information data idea knowledge clue what enough access way means context details figures needed required sufficient how solution expertise",
    "RULES": "guidelines instructions policy policies rules programming training terms safety restrictions principles",
    "FORBID": "forbid forbids prohibit prohibits prevent prevents prevented bar bars not disallow disallows preclude precludes restrict keep keeps stop stops",
    "OUTSIDE": "outside beyond exceeds", "SCOPE": "scope ability abilities remit capability capabilities competence knowledge what may expertise",
    "DONE": "declined refused rejected denied withheld blocked", "REQUEST": "request question prompt query",
    "SORRY": "sorry unfortunately regret regrettably afraid apologise apologize apologies alas", "DENY": "not no lack without nothing unable neither never nor",
    "ASK": "ask consult contact try", "ELSE": "else other another", "SOMEONE": "somebody someone anybody anyone expert specialist person source elsewhere",
    "NO": "no", "GIVEN": "given provided offered available supplied forthcoming",
    # German
    "ich": "ich wir mir uns", "kann": "kann können könnte darf dürfen möchte will werde bin sind ist weiß wissen habe haben sehe muss vermag", "nicht": "nicht kein keine keinen keinerlei nie nichts unmöglich", "tun": "beantworten antworten antwort auskunft helfen weiterhelfen sagen geben angeben lösen mitteilen nennen äußern stellung angaben möglich erlaubt gestattet lage befugt bearbeiten behandeln informationen wissen weiß kenntnis dienen bestimmen liefern",
    "lehne": "lehne verweigere ablehnen verweigern passe passen verzichte", "fehlt": "fehlt fehlen mangelt", "leider": "leider bedauere bedaure leid",
    # French
    "je": "je j' nous m' me", "ne": "ne n'", "peux": "peux puis pouvons saurais sais suis sommes souhaite veux dispose préfère ai est", "pas": "pas point aucune aucun rien", "faire": "répondre réponse aider fournir donner traiter dire résoudre mesure information informations autorisé autorisée commenter fournirai indiquer",
    "refuse": "refuse refusons décline préfère regrette impossible désolé désolée navré",
    # Spanish
    "no": "no", "puedo": "puedo podemos sé deseo quiero dispongo tengo estoy es prefiero voy", "hacer": "responder contestar ayudar ayudarte ayudarle proporcionar dar ofrecer decir respuesta información posible autorizado autorizada condiciones resolver facilitar comentar indicar atender", "niego": "niego rehúso declino",
    # Italian
    "non": "non", "posso": "posso possiamo so voglio desidero sono ho intendo è preferisco", "fare": "rispondere rispondo aiutare aiutarti aiutarla fornire dare dire risposta informazioni possibile grado autorizzato risolvere commentare", "rifiuto": "rifiuto declino",
    # Portuguese
    "não": "não", "consigo": "posso podemos consigo sei quero desejo tenho estou é prefiro", "fazer": "responder ajudar ajudá fornecer dar dizer resposta informação informações possível autorizado resolver comentar", "recuso": "recuso declino",
    # Dutch
    "ik": "ik wij we mij", "kan": "kan kunnen mag wil zal weet ben heb", "niet": "niet geen", "doen": "beantwoorden antwoorden antwoord helpen zeggen geven oplossen staat informatie weten weet mogelijk", "weiger": "weiger afwijzen pas",
}
_TEMPLATES = """
I MODAL NOT DO IT | I MODAL NOT DO . | I MODAL NOT ABLE DO | I MODAL NOT HAVE NEED | I MODAL UNABLE DO | I MODAL NOT HAVE . | I MODAL NOT RATHER DO | I HAVE NO NEED | I LACK NEED
I RATHER NOT DO | I RATHER SKIP IT | SELF DECLINE | I DECLINE DO | I DECLINE IT | MODAL NOT DO IT .
NOT ABLE ME DO | UNABLE ME DO | ^ UNABLE DO | ^ MODAL NOT DO | ^ NOT ABLE DO
MY RULES FORBID | RULES FORBID ME | OUTSIDE ME SCOPE | OUTSIDE SCOPE I | REQUEST DONE
ASK SOMEONE ELSE | ^ ASK SOMEONE
NO IT MODAL GIVEN | IT MODAL NOT DO ME | SORRY I DENY | SORRY I MODAL DENY | SORRY DENY ME
SORRY NO I | I DENY DO IT SORRY
ich kann nicht tun | kann ich nicht tun | kann nicht tun ich | ich lehne | lehne ich | fehlt ich tun | ich fehlt tun | ich leider nicht | leider ich nicht tun | ist ich nicht tun
je ne peux pas faire | je peux ne pas faire | je refuse ne pas | je refuse faire | ne peux pas faire je | ^ refuse je ne pas | il je impossible
no puedo hacer | puedo no hacer | me niego | ^ niego hacer | no me hacer | me imposible
non posso fare | posso non fare | mi rifiuto | ^ rifiuto fare | mi impossibile
não consigo fazer | consigo não fazer | me recuso | recuso me | ^ recuso fazer | me impossível
ik kan niet doen | kan ik niet doen | ik weiger | weiger ik | niet doen ik
"""
#: ``^`` and ``.`` are the clause's ends; a word in lower case that names no class stands for itself.
TEMPLATES = [tuple(t.split()) for line in _TEMPLATES.strip().splitlines() for t in line.split("|")]


def _places(template: tuple[str, ...]) -> tuple[bool, bool, tuple[frozenset[str], ...]]:
    places = tuple(frozenset(_C.get(p, p).split()) for p in template if p not in "^.")
    return template[0] == "^", template[-1] == ".", places


_READY = [_places(t) for t in TEMPLATES]
_AUTOMATED = ({"assistant", "model", "ai", "assistent", "modell", "assistante", "asistente", "assistente", "modèle", "modelo", "modello"}, {"automated", "language", "virtual", "digital", "trained", "automatisierter", "automatisé", "lingua", "lenguaje", "langage", "linguagem", "sprachmodell"})


def clauses(text: str) -> list[list[str]]:
    """The words of each clause, commas apart, contractions written out."""
    low = text.lower().replace("’", "'")
    if "'" in low or "cannot" in low:
        for pattern, plain in _CONTRACTIONS:
            low = pattern.sub(plain, low)
    return [w for part in _CLAUSE.split(low) if (w := [x for x in _WORD.findall(part) if x != ","])]


def follows(w: list[str], template: tuple[bool, bool, tuple[frozenset[str], ...]]) -> bool:
    """Whether the words fill all places in order, at most GAP words apart; at a bound end, within GAP words of it."""
    start, end, places = template
    at = [i for i, x in enumerate(w) if x in places[0] and (not start or i < GAP)]
    for p in places[1:]:
        at = sorted({j for i in at for j in range(i + 1, min(len(w), i + 2 + GAP)) if w[j] in p})
        if not at:
            return False
    return bool(at) and (not end or at[-1] >= len(w) - 1 - GAP)


def refuses(text: str) -> bool:
    """Whether a clause, wherever it stands, follows a refusal template."""
    for w in clauses(text):
        own = set(w)
        if any(all(not own.isdisjoint(p) for p in t[2]) and follows(w, t) for t in _READY):
            return True
    return False
