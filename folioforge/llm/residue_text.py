"""What template residue, filler and error texts look like: general seeds, and fields by parsing.

The seeds are messages that widely used servers, frameworks and site builders
show by default.  What a corpus says in words of its own is learned from it
(:mod:`folioforge.llm.residue`); nothing here is taken from a particular corpus.
"""

from __future__ import annotations

import bisect
import re

# Unfilled fields of common template languages, of any length.
FIELD = re.compile(
    r"\{\{.*?\}\}"
    r"|[$#]\{[^{}]+\}"
    r"|\{%.*?%\}"
    r"|<%.*?%>"
    r"|<\?(?:=|php\b).*?\?>"
    r"|\[\[[^\[\]]+\]\]"
    r"|(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%"
    r"|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)"
    r"|\[(?:INSERT|ADD|ENTER|YOUR)\b[A-Z0-9_ ]+\]"
    r"|\{\d+\}"
    r"|\{[a-z]+(?:[_.][a-z]+)+\}"
    r"|@(?:Model|ViewBag|ViewData|Html)\.\w+"
    r"|\[object Object\]"
    r"|\bNaN (?:out of|of|/) NaN\b",
    re.S,
)
#: The value ``undefined`` where a text should stand: it neither qualifies a noun nor completes a verb.
UNDEFINED = re.compile(
    r"(?<!\bis )(?<!\bare )(?<!\bwas )(?<!\bbe )(?<!\bwere )(?<!\bbeen )(?<!\bleft )(?<!\bcalled )(?<!\bremains )(?<!\bremain )(?<!\ban )(?<!\bthe )(?<!\bas )"
    r"(?<!\bof )\bundefined\b(?! (?:behaviou?r|method|index|array|variable|function|constant|offset|property|reference|term|word|value|result|symbol)s?\b)"
    r"|\bof undefined\b(?= (?:and|or|on|in|for|from|at|by)\b|\W*$)"
)
# Words of writing about templates, and verbs that tell an author to write a field.
_ABOUT_TEMPLATES = re.compile(
    r"\b(?:template|theme|source|config\w*|html|css|markup|syntax|placeholder|variable|snippet|shortcode|expression|curly braces|double braces|code|vorlage|gabarit|plantilla|modèle|шаблон\w*)\b", re.I
)
_WRITE = re.compile(
    r"(?:\b(?:write|writes|type|types|use|uses|using|put|puts|insert|enter|add|paste|replace|replaces|called|named|like|say|says|means|syntax|tag|variable|placeholder|field|expression|token|schreibe|verwende|écrivez|utilisez|escriba|use|напишите)|[\"“«'`])\W*$",
    re.I,
)
# Words of the usual Latin filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim"
    " veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit"
    " esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# What people type to fill a space.
_MASHED = frozenset("asdf asd sdf dfg fgh jkl jklö qwe qwer qwert qwerty qwertz azerty foo bar baz blah bla xyz abc xxx xxxx test tests testing probe essai prueba тест".split())
# Heads of filler texts that name themselves such, notes to the author, in several languages.
_FILLER = re.compile(
    r"\W*(?:(?:this|here) is (?:a |an |some |your )?)?(?:sample|dummy|placeholder|filler) (?:heading|title|text|texts|paragraph|sentence|content|copy|subtitle|caption|headline)\b"
    r"|\W*(?:\w+ ){0,3}placeholder\W+(?:insert|replace|add|put|edit)\b"
    r"|\W*(?:text|copy|content|image|title|headline|description|caption) (?:goes|comes|to come|coming|to follow|tbd|tbc)\b"
    r"|\W*(?:dies(?:er|es) (?:ist ein )?)?(?:blindtext|platzhalter(?:text)?|mustertext|beispieltext)\b"
    r"|\W*texte? (?:provisoire|fictif|factice|d['’]exemple|de remplissage|à remplacer)\b"
    r"|\W*texto (?:de (?:ejemplo|relleno|muestra|prueba|exemplo|preenchimento)|provisional|provisório|simulado|ficticio|fictício)\b"
    r"|\W*testo (?:segnaposto|di esempio|provvisorio)\b"
    r"|\W*(?:пример текста|текст[ -](?:заполнитель|рыба)|здесь будет текст)\b",
    re.I,
)
_NOTE = re.compile(r"\W*(?:TODO|TBD|FIXME|XXX+)\b(?=\W)")
_NOTE_END = re.compile(r"\bXXX+\W*\Z")
# Default messages of servers, frameworks, browsers and site builders, and their usual translations.
MESSAGES = """
page not found
the page you requested could not be found
the page you are looking for does not exist
the page you are looking for might have been removed had its name changed or is temporarily unavailable
sorry the page you are looking for could not be found
we can't find the page you're looking for
oops that page can't be found
it looks like nothing was found at this location
the requested url was not found on this server
the requested resource could not be found
this page does not exist
this page has moved
nothing found
oops something went wrong
something went wrong
something went wrong please try again
something went wrong please try again later
an error occurred
an unexpected error has occurred
an error occurred while processing your request
sorry an error has occurred
internal server error
the server encountered an internal error and was unable to complete your request
the server encountered an internal error or misconfiguration and was unable to complete your request
application error a client side exception has occurred
bad gateway
bad request
gateway timeout
service unavailable
service temporarily unavailable
the service is temporarily unavailable
the server is temporarily unable to service your request due to maintenance downtime or capacity problems
down for maintenance
this site is down for maintenance
briefly unavailable for scheduled maintenance
we'll be back soon
please try again later
too many requests
access denied
forbidden
you don't have permission to access this resource
you do not have permission to access this page
you are not authorized to view this page
your session has expired
your session has expired please log in again
please log in to continue
please sign in to continue
this content is not available in your country
this content is currently unavailable
failed to load content
error establishing a database connection
could not connect to the database
traceback most recent call last
uncaught exception
uncaught error call to undefined function
fatal error call to undefined function
fatal error call to undefined method
warning undefined array key
warning undefined variable
notice undefined index
null pointer exception
index of
welcome to nginx
apache http server test page
it works
seite nicht gefunden
die seite wurde nicht gefunden
die angeforderte seite wurde nicht gefunden
die gesuchte seite existiert nicht
ein fehler ist aufgetreten
bitte versuchen sie es später erneut
zugriff verweigert
page introuvable
page non trouvée
la page demandée est introuvable
désolé cette page n'existe pas
une erreur est survenue
accès refusé
página no encontrada
la página solicitada no existe
la página que busca no existe
lo sentimos no se ha encontrado la página
ha ocurrido un error
acceso denegado
página não encontrada
a página que você procura não existe
ocorreu um erro
страница не найдена
запрошенная страница не существует
произошла ошибка
доступ запрещён
pagina non trovata
please enable javascript
please enable javascript to continue
please enable javascript to view this page
please enable javascript in your browser
please turn on javascript
please turn on javascript to continue
enable javascript and cookies to continue
javascript is required
javascript is disabled in your browser
this site requires javascript
this page requires javascript
this app requires javascript
you need to enable javascript to run this app
your browser does not support javascript
this site does not work without javascript
checking your browser
checking your browser before accessing the site
checking if the site connection is secure
verifying you are human
bitte aktivieren sie javascript
bitte aktivieren sie javascript um diese seite zu nutzen
diese seite benötigt javascript
veuillez activer javascript
veuillez activer javascript pour continuer
ce site nécessite javascript
por favor active javascript
active javascript para continuar
este sitio requiere javascript
por favor ative o javascript
este site requer javascript
пожалуйста включите javascript
для работы сайта необходим javascript
attiva javascript per continuare
your text here
your text goes here
your content goes here
your title here
add your heading text here
add your text here
insert text here
insert your text here
enter your text here
replace this text
replace this text with your own
click to edit
click here to edit
click to add text
click here to add your own text and edit me
click edit button to change this text
double click to edit
this is an example page
this is your first post
edit or delete it then start writing
just another wordpress site
hello world
this is a sample page
this is a sample paragraph
hier steht ihr text
hier steht bald ihr text
hier kommt ihr text hin
hier entsteht eine neue internetpräsenz
votre texte ici
insérez votre texte ici
su texto aquí
escriba aquí su texto
seu texto aqui
insira seu texto aqui
ваш текст здесь
введите текст
website coming soon
under construction
""".strip().split("\n")
# Titles that are messages.
TITLES = re.compile(
    r"^\W*(?:(?:error|fehler|erreur|http|status)\s*)?\d{3}\W*$|^\W*(?:error|fehler|erreur)\W*\d*\W*$"
    r"|^\W*(?:\d{3}\W+)?(?:page not found|not found|oops|server error|internal server error|bad gateway|service unavailable|access denied|forbidden|seite nicht gefunden|"
    r"página no encontrada|página não encontrada|page introuvable|страница не найдена|untitled(?: document)?|just a moment|loading)\W*$",
    re.I,
)
_TITLE_PARTS = re.compile(r"\s(?:\||–|—|·|-|•|â€“|Â·|:)\s|\s\|")
_LATIN = re.compile(r"\b(?:lorem|ipsum|dolor|amet|nostrud|cillum|veniam|fugiat|laboris|pariatur|aliquip|occaecat|excepteur)\b", re.I)
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
#: RE2 superset of what :func:`contains_field` accepts.
MAYBE_FIELD = (
    r"\{\{|\$\{|#\{|\{%|<%|<\?|\[\[|%[A-Z]|__[A-Z]|\[[A-Z]{3}|\{\d|\{[a-z]|@[A-Z]|\[object|undefined|NaN|TODO|TBD|FIXME|XXX"
    r"|(?i:lorem|ipsum|dolor|amet|nostrud|cillum|veniam|fugiat|laboris|pariatur|sample|dummy|placeholder|filler|blindtext|platzhalter|mustertext|beispieltext"
    r"|(?:text|copy|content|image|title|headline|description|caption) (?:goes|comes|to come|coming|to follow|tb[dc])|\btext[eo]? [pfdsà]|testo |текст|asd|qwe|azerty|\bfoo\b|\bblah?\b|\btest|\bxyz\b|\bprobe\b|\bessai\b|\bprueba\b)"
)


def _is_mention(sentence: str, at: int) -> bool:
    """Whether a sentence with a field at ``at`` tells about it: an author is told to write it, in a text on templates."""
    return bool(_WRITE.search(sentence[:at]) and _ABOUT_TEMPLATES.search(sentence))


_MASHED_ONE = re.compile(r"\b(?:" + "|".join(sorted(_MASHED)) + r")\b", re.I)
_FIELD_SIGNS = re.compile(r"[{\[%@]|<[%?]|__|NaN")


def contains_field(text: str) -> bool:
    """Whether a text holds an unfilled field, filler or a note to its author, and does not write about it."""
    if _FILLER.match(text) or _NOTE.match(text) or "XXX" in text and _NOTE_END.search(text):
        return True
    hits = [m.start() for m in FIELD.finditer(text)] if _FIELD_SIGNS.search(text) else []
    if "undefined" in text:
        hits += [m.start() for m in UNDEFINED.finditer(text)]
    if hits:
        cuts = [0, *(m.end() for m in _SENTENCES.finditer(text)), len(text) + 1]
        for h in hits:
            k = bisect.bisect_right(cuts, h) - 1
            if not _is_mention(text[cuts[k] : cuts[k + 1]], h - cuts[k]):
                return True
    latin, mashed = _LATIN.search(text), _MASHED_ONE.search(text)
    if latin or mashed:
        for s in _SENTENCES.split(text):
            words = re.findall(r"[^\W\d_]+", s.lower())
            if len(words) >= 2 and (latin and sum(w in LOREM for w in words) >= 0.7 * len(words) or mashed and all(w in _MASHED for w in words)):
                return True
    return False


def title_parts(text: str) -> list[str]:
    """The parts of a title between its separators: what it is about, and the names of sections and site."""
    return [p for p in (q.strip() for q in _TITLE_PARTS.split(text)) if p]
