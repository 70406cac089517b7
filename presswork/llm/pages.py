"""What of a page is its article: two passes of block rules (problem 4).

First pass: every line is a block. Its stop-word density, length and link density (how much of it
is short items between separators) decide it as body or boilerplate, or leave it open; phrases by
which sites speak of themselves are a prior for sources of which little is known. What a source
repeats under many titles (counted over the corpus in mainbody.py) is boilerplate whatever it
looks like: whole lines, and the labels that lead or trail a short one. Second pass: open blocks,
which are short, take the label of the nearest decided neighbours; headlines under a list of
recommendations belong to it.

Everything here is plain Python on one page at a time; the DataFrame side is in mainbody.py.
"""

from __future__ import annotations

import re

NONE, BODY, NOISE, OPEN, HEADER = 0, 1, 2, 3, 4
LONG = 260  # characters from which a finished block with stop words is prose, whatever it speaks of
STOPS, FEW_STOPS = 0.15, 0.06  # stop-word density of short prose and of long
LABELLED, LABEL_WORDS = 160, 5  # characters of a line that a label leads or trails; words of the label

# Frequent function words of the four languages.
STOP_EN = "the of and to in a that for with on at is was by from would as it be had has have not its their this which who will would or an are were they he she his her than"
STOP_DE = "der die das und zu den von für mit im in am ist dem des ein eine auf sich nicht es als auch an bei aus wie nach über um wird war nur noch vor weder wer zur zum hat"
STOP_FR = "le la les de des du et à en un une que qui dans pour par sur au aux est ne pas plus ce se avec il elle sont d' l' qu' avant selon a été"
STOP_ES = "el la los las de del y en un una que por con para al se su no es lo más como pero sus le ha o sin si según ni cuyo"
STOP = frozenset(f"{STOP_EN} {STOP_DE} {STOP_FR} {STOP_ES}".split())

# Names of sections and entries of menus.
SECTIONS = frozenset(
    "home world business technology tech politics culture sport sports weather opinion letters video videos podcasts markets science health travel arts money us uk "
    "startseite ausland inland wirtschaft technik kultur meinung wetter mediathek börse politik wissen reise gesundheit "
    "accueil monde économie sciences débats vidéos marchés politique météo société santé "
    "portada mundo economía mercados política deportes cultura ciencia vídeos tiempo opinión sociedad salud".split()
)
_BULLET = re.compile(r"^(?:[•·*▪»›>]+|[-–—](?=\s))\s*")
_TRAIL = re.compile(r"[\s»›]+$")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|‘[^’]*’(?!\w)|\"[^\"]*\"")
_END = re.compile(r"[.!?…](?:[”“»’\"')\]]|\s*\[\^[^\]]*\])*$|[”»]$")
_TWO = re.compile(r"[a-zß-ÿ”»][.!?][”»\"]?\s+[A-ZÀ-Þ„“«¿¡]")  # a sentence and the next one's beginning
_SEPARATOR = re.compile(r"\s*[|·•»›>]\s*|\s+/\s+|\s{3,}")

#: Headings over recommended pages.
TEASER_HEADS = re.compile(
    r"^(?:trending(?: now)?|you may (?:also )?like|most (?:read|popular|viewed)|recommended(?: for you)?|more (?:from|in|on|stories|news)\b.*|editors?[’'] picks?|related(?: stories| articles| links)?"
    r"|read (?:also|next)|see also|popular now|latest(?: news)?|meistgelesen|mehr (?:zum thema|aus|dazu)\b.*|das könnte sie auch interessieren|lesen sie auch|empfohlen(?: für sie)?|auch interessant"
    r"|les plus lus|à lire (?:aussi|également)|sur le même (?:sujet|thème)|nos recommandations|recommandé pour vous|más (?:noticias|leídas?|información)|lo más (?:leído|visto)|te puede interesar|lea también|relacionad[oa]s?|recomendad[oa]s?)\s*:?$"
)
_TEASER = re.compile(
    r"^(?:\d+ min(?:uten|utes|utos)?\b\s*[–—:-]|(?:read (?:more|also|next)|related|see also|more|mehr dazu|lesen sie auch|à lire(?: aussi)?|lire aussi|sur le même sujet|lea también|más información|relacionado|le puede interesar|sigue leyendo)\s*[:—–-])"
)
#: Whole short lines by which a page talks about itself: access, consent, sharing, dates, credits.
_SITE_LINE = re.compile(
    "^(?:"
    # access and navigation
    r"(?:log|sign) ?(?:in|out|up)\b.{0,40}|subscribe(?: now)?\b.{0,30}|register|my account|account|menu\b.{0,40}|search|home|skip to .{0,30}|(?:back to |go to )?top|back to .{0,20}|text size\b.*|save for later|print|e-?mail|copy link|share\b.{0,60}"
    r"|anmelden\b.{0,30}|abonnieren|mein konto|startseite|nach oben|zum inhalt.{0,20}|link kopieren.{0,30}|drucken|(?:artikel|beitrag|seite) (?:teilen|drucken|merken)|teilen.{0,30}|merken"
    r"|se connecter\b.{0,30}|s['’]abonner|mon compte|accueil|retour en haut|aller au contenu|partager\b.{0,30}|imprimer|copier le lien.{0,30}"
    r"|iniciar sesi[óo]n.{0,30}|suscr[íi]b\w+.{0,30}|mi cuenta|portada|volver arriba|ir al contenido|compartir\b.{0,30}|copiar enlace.{0,30}|imprimir|guardar"
    # consent
    r"|(?:i )?(?:agree|accept)(?: all)?\b.{0,40}|reject all\b.{0,30}|manage (?:settings|choices|cookies).{0,20}|only (?:what is|those) (?:needed|necessary)|(?:only )?(?:necessary|essential)(?: cookies)?(?: only)?|your privacy.{0,40}"
    r"|alle(?:s)? (?:akzeptieren|annehmen).{0,40}|(?:nur )?notwendige.{0,30}|einstellungen.{0,20}|tout (?:accepter|refuser).{0,40}|continuer sans accepter|param[éèe]trer.{0,20}|aceptar\b.{0,40}|rechazar\b.{0,30}|configurar"
    # counts
    r"|[\d.,\s]+(?:shares?|comments?|views?|likes|mal geteilt|kommentare?|partages?|commentaires?|comentarios?|veces compartid\w*)\b.{0,20}|(?:comments?|kommentare?|commentaires?|comentarios?)\s*\(?[\d.,\s]*\)?|join the conversation|(?:leave|post) a comment|jetzt mitreden|réagir|opine|[\d.,\s]+(?:people|readers|personen|personnes|personas)\b.{0,50}"
    # dates and reading time
    r"|(?:last )?(?:updated?|published|posted|first published|veröffentlicht|aktualisiert|stand|publié|mis à jour|modifié|publicado|actualizado)\b.{0,60}\d.{0,40}"
    r"|(?:\w{2,10}\.?,?\s+)?\d{1,2}\.?\s+(?:de\s+)?[^\W\d_]{3,10}\.?\s+(?:de\s+)?\d{4}.{0,40}|(?:\w{2,10},?\s+)?[^\W\d_]{3,10}\s+\d{1,2},?\s+\d{4}.{0,40}|\d[\d./: -]+(?:uhr|h|gmt|utc|am|pm|[ap]\.m)\.?"
    r"|(?:lesezeit|lecture|lectura|temps de lecture|tiempo de lectura|reading time)\b.{0,30}\d.{0,20}|listen to this .{0,40}"
    # people and pictures
    r"|(?:by|von|par|por|text|texte|texto)\s+(?:[^\W\d_]++[\s-]?+){1,5}+(?:,.{0,40})?|reporting by\b.*|(?:editing|edited) by\b.*"
    r"|(?:picture|photo|image|foto|bild|imagen|crédit|credit|illustration)s?\s*:.*"
    # advertising and offers
    r"|advertisements?|sponsored(?: content)?|anzeige|werbung|publicité|publicidad|anuncio|story continues below.{0,20}|continue reading .{0,60}|article continues.{0,30}|nach der werbung.{0,40}|la suite après.{0,40}|sigue leyendo.{0,40}|read the full story|(?:article )?réservé à nos.{0,30}|contenido para suscriptores|nur für abonnenten"
    # imprint
    r"|contact(?: us)?|kontakt|contacto|nous contacter|impressum|imprint|datenschutz|privacy(?: policy)?|terms(?: of (?:use|service))?|careers|advertise|corrections|mentions légales|confidentialité|aviso legal|privacidad|about (?:us|[^\W\d_]+(?:\s[^\W\d_]+){0,3}\s+careers\b.*)"
    ")$"
)
#: The same for those that may begin with anything: each with the words of which a line needs one.
_SITE_ENDS = tuple(
    (keys, re.compile(f"^(?:{ends})$"))
    for keys, ends in (
        (("min",), r".{0,30}\(?\d[\d.,]* ?min(?:\.|uten|utes?|utos|s)?(?: read| lesen| de lecture| de lectura)?\)?"),
        (("staff writer", "correspondent", "reporter", "redaktion", "redacción", "rédaction", "freelance"), r"(?:[^\W\d_]++\s*+){1,5}+(?:\||,|–|-)\s*(?:staff writer|correspondent|reporter|redaktion|redacción|à la rédaction|rédaction|freelance.{0,12})"),
        (("reports", "reporting", "berichtet", "rapporte", "informa"), r"(?:[^\W\d_]+\s+){1,4}(?:reports|reporting|berichtet|rapporte|informa)"),
        (("picture", "photo", "image", "foto", "bild", "imagen"), r".{0,140}\((?:picture|photo|image|foto|bild|imagen)s?\s*:.{1,60}\)|.{0,120}\.\s*(?:photo|foto|bild|picture|image|imagen)s?\b\s*:?.{1,50}"),
        ((" / ",), r".{1,60} / .{1,40} archive?s?"),
    )
)
#: Statements about rights, origin and liability, in any length.
_NOTICE = re.compile(
    r"©|\(c\) \d{4}|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|no part of this (?:material|article|page|site)|may not be (?:copied|reproduced|republished)|written (?:consent|permission) of"
    r"|nachdruck nur|nachdruck.{0,30}verboten|toute reproduction|prohibida la reproducción|reproduction interdite|views expressed|opinions expressed|first appeared (?:in|on)|erschien zuerst|a paru dans|publicad[oa] (?:originalmente|por primera vez)|(?:apareció|se publicó) (?:primero |originalmente )?en\b|publiée? (?:d['’]abord|initialement)|zuerst erschienen"
    r"|is (?:published|owned|operated) by|quotes are delayed|advice to buy or sell|keine anlageberatung|(?:diese|unsere) (?:seite|website) (?:nutzt|verwendet)|ce site (?:dépose|utilise)|este sitio (?:usa|utiliza)|this (?:site|website|page) uses"
)
_ADDRESS = re.compile(r"\b(?:you|your|yours|we|our|us|sie|ihre?[nrms]?|wir|unser\w*|vous|votre|vos|nous|notre|nos|usted|su consentimiento|nosotros|nuestr\w+|usamos|acepta)\b")
_OFFER = re.compile(
    r"cookie|tracker|traceur|partners?\b|partner|socios|privacy|datenschutz|your data|our (?:app|emails?|evening|morning|daily|newsletter|site|journalism)|newsletter|inbox|briefing|abendbrief|boletín|infolettre|subscri|abonn|suscri|sign up|in confidence|newsdesk|have a tip|download|app\b|members? read|read(?:ing)? this page|service running|which stories are read|choose how|change your choices|bottom of any page|mailing list|leave the list|personalis|advertising|publicit|werbung|audience|kostenlos|gratis|gratuit|free,? every"
)
_IMPERATIVE = re.compile(r"^(?:sign up\b|subscribe\b|download\b|get the\b|join\b|enjoying this|have a tip|der \w+brief|follow us|before you go|support|become a|la lettre|le brief|el boletín|la carta|recibe|inscri|abonnez|suscríb)")


#: Cheap necessary conditions of the two patterns above: one of these substrings.
_NOTICE_KEYS = ("©", "(c)", "copyright", "rights", "rechte", "droits", "derechos", "no part", "not be", "written", "nachdruck", "reprodu", "views", "opinions", "appeared", "erschien", "a paru", "public", "apareció", "publié", "erschienen", "is published", "is owned", "is operated", "delayed", "advice", "beratung", "nutzt", "verwendet", "dépose", "utilis", "usa ", "utiliza", "uses")
_OFFER_KEYS = ("cookie", "track", "trace", "partner", "partenaire", "socios", "privacy", "datenschutz", "data", "our ", "newsletter", "inbox", "brief", "boletín", "infolettre", "subscri", "abonn", "suscri", "sign up", "confiden", "newsdesk", "tip?", "download", "app", "members", "reading", "read this", "service", "which stories", "choose how", "choices", "page", "list", "personal", "advertis", "publici", "werbung", "audience", "kostenlos", "gratis", "gratuit", "free")


_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(line: str) -> str:
    """What lines are compared by: their letters, in lower case."""
    return _NO_LETTER.sub("", line.lower())


def link_density(line: str) -> float:
    """Share of a line that is short items (up to three words) between separators; 0 for one item."""
    items = [x for x in _SEPARATOR.split(line.strip()) if _LETTER.search(x)]
    if len(items) < 2:
        return 0.0
    short = sum(len(x) for x in items if len(_WORD.findall(x)) <= 3)
    return short / max(1, sum(map(len, items)))


def site_line(core: str) -> bool:
    """Is a short line one by which a page talks about itself?"""
    return bool(_SITE_LINE.match(core)) or any(any(map(core.__contains__, keys)) and ends.match(core) for keys, ends in _SITE_ENDS)


def stop_density(words: list[str]) -> float:
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def classify(line: str) -> tuple[int, bool]:
    """First pass: (label, it is a list item) of one line."""
    if not _LETTER.search(line):
        return NONE, False
    text = " ".join(line.split())
    if len(text) >= LONG and _END.search(text[-60:]) and stop_density(text.lower().split()) >= FEW_STOPS:
        return BODY, False
    bare = _BULLET.sub("", text)
    item = bare != text
    bare = _TRAIL.sub("", bare)
    low = bare.lower()
    core = low.rstrip(" .")
    if len(low) < 160:
        if _TEASER.match(low):
            return NOISE, item
        if TEASER_HEADS.match(core):
            return HEADER, item
        if site_line(core):
            return NOISE, item
        if link_density(line) > 0.7 or (link_density(bare) > 0.7 and not _END.search(bare)):
            return NOISE, item
    brief = len(low) < LONG
    notice, offer = brief and any(map(low.__contains__, _NOTICE_KEYS)), brief and any(map(low.__contains__, _OFFER_KEYS))
    unquoted = _QUOTED.sub(" ", low) if notice or offer else ""
    if notice and _NOTICE.search(unquoted):
        return NOISE, item
    words = _WORD.findall(low)
    if offer and (_IMPERATIVE.match(low) or (_ADDRESS.search(unquoted) and not low.startswith(("“", "„", "«")))) and _OFFER.search(unquoted):
        return NOISE, item
    if 3 <= len(words) <= 25 and sum(w in SECTIONS for w in words) >= 0.6 * len(words):
        return NOISE, item
    n, ended = len(words), bool(_END.search(bare[-60:]))
    stops = stop_density(words)
    if n >= 10 and stops >= FEW_STOPS and (ended or n >= 22 or _TWO.search(bare)) or n >= 5 and ended and stops >= STOPS and not item:
        return BODY, item
    if n <= 2 and not item and not any(c.isdigit() for c in low):
        return NOISE, item
    if n == 1 and not any(c.isdigit() for c in low):
        return NOISE, item
    return OPEN, item


_MARKED = re.compile(r"\s*(?:[»›>]|\d{1,2}\.\s|\d+ min)")
ITEM, BLANK, MARKED, QUOTED, UPPER, SITE, TITLE = (1 << i for i in range(3, 10))
_SIZE, _WIDTH, _MOST = 10, 15, 31
CUT = 2  # words of a last line that may be what is left of a cut one


def look(line: str) -> int:
    """First pass over one line: its label and what the second pass asks of it, packed into one number."""
    label, item = classify(line)
    code = label | ITEM * item
    if label == BODY:
        return code
    bare = line.strip()
    if not bare:
        return code | BLANK
    code |= MARKED * bool(_MARKED.match(line)) | QUOTED * bool(_QUOTED.match(bare)) | UPPER * bare[:1].isupper()
    size = len(_WORD.findall(line))
    if size <= CUT and code & UPPER and site_line(bare.lower().rstrip(" .»")):
        code |= SITE  # of other lines nobody asks
    return code | min(_MOST, size) << _SIZE | min(_MOST, len(bare.split())) << _WIDTH


def looks(lines: list[str], title: str | None = None, cache: dict | None = None) -> list[int]:
    """First pass over a page; ``cache`` remembers short lines from page to page."""
    title = " ".join((title or "").split()).lower()
    out = []
    for line in lines:
        code = cache.get(line) if cache is not None else None
        if code is None:
            code = look(line)
            if cache is not None and len(line) < 200:
                if len(cache) > 50_000:
                    cache.clear()
                cache[line] = code
        if title and code & 7 == OPEN and " ".join(line.split()).lower().strip(" .»•*-") == title:
            code |= TITLE
        out.append(code)
    return out


_LEAD = re.compile(r"[^:—–]{2,40}?(?=\s*:\s|\s[—–]\s)")
_TAIL = re.compile(r"(?:\.\s|\(|\s/\s|:\s|\s[—–|]\s)([^.(/:—–|]{2,40}\)?|[^.(/—–|]{2,20}:\s[^.(/:—–|]{2,30}\)?)$")


def segments(line: str) -> list[str]:
    """The labels that lead or trail a short line: what stands before its first colon or dash, and
    behind its last full stop, bracket, stroke or colon. List items have none."""
    bare = " ".join(line.split())
    if len(bare) >= LABELLED or _BULLET.match(bare):
        return []
    found = []
    lead = _LEAD.match(bare)
    if lead and len(lead[0].split()) <= LABEL_WORDS:
        found.append(f"<{lead[0]}")
    trail = _TAIL.search(bare)
    if trail and len(trail[1].split()) <= LABEL_WORDS:
        found.append(f">{trail[1]}")
    return found


def marks(line: str) -> tuple[str, str, str]:
    """What is counted of a line: its letters, and those of the labels that lead and trail it. Of long
    lines, which nobody varies by a figure, case and blanks alone are left out."""
    if len(line) >= LONG:
        return "".join(line.lower().split()), "", ""
    labels = {label[0]: label[0] + key for label in segments(line) if (key := letters(label))}
    return letters(line), labels.get("<", ""), labels.get(">", "")


def settle(codes: list[int], repeated: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """Second pass: BODY, NOISE or NONE (no letter) of every line of a page, from what the first
    pass saw and the numbers (from 0) of the lines that its source repeats."""
    labels = [NOISE if i in repeated and c & 7 not in (NONE, HEADER) else c & 7 for i, c in enumerate(codes)]
    first = list(labels)
    size = lambda i: codes[i] >> _SIZE & _MOST
    item = lambda i: bool(codes[i] & ITEM)
    marked = lambda i: bool(codes[i] & MARKED)
    last = max((i for i, x in enumerate(labels) if x != NONE), default=-1)
    before = next((labels[i] for i in range(last - 1, -1, -1) if labels[i] != NONE), NONE)
    if last >= 0 and labels[last] in (NOISE, OPEN) and not item(last) and last not in repeated:
        # a text that was cut: its last words continue the body, or the footer
        if size(last) <= CUT and before == BODY and codes[last] & UPPER and not codes[last] & SITE:
            labels[last] = OPEN
    if last >= 0 and labels[last] == OPEN:
        # an unfinished line at the end of a text is where it was cut: long ones are prose
        if before not in (HEADER, OPEN) and not marked(last) and (size(last) >= 8 or size(last) >= 3 and BODY not in labels):
            labels[last] = BODY
    near = lambda i, step: next((k for k in range(i + step, last + 1 if step > 0 else -1, step) if not codes[k] & BLANK), -1)
    listed = lambda i: i >= 0 and first[i] == OPEN and item(i)
    teaser, prefixed, length = False, False, 0
    for i, x in enumerate(labels):
        if x == HEADER:
            teaser, prefixed, length, labels[i] = True, False, 0, NOISE
        elif x == OPEN and codes[i] & TITLE:
            labels[i] = NOISE
        elif x == OPEN and marked(i):
            prefixed, length, labels[i] = True, length + 1, NOISE
        elif x == OPEN and item(i) and (listed(near(i, 1)) or listed(near(i, -1))):
            teaser, labels[i] = False, BODY  # two items or more are a list, which articles have
        elif teaser and x == OPEN:
            # a line without the mark of those before it, or a short one just above a paragraph, is a subhead
            after, width = near(i, 1), codes[i] >> _WIDTH & _MOST
            odd = prefixed or codes[i] & QUOTED or (length >= 2 and width <= 7)
            alone = not length and width <= 8
            if after >= 0 and first[after] == BODY and (alone or length and odd):
                teaser, labels[i] = False, BODY
            else:
                length, labels[i] = length + 1, NOISE
        elif x == BODY or codes[i] & BLANK:
            teaser = False
        elif x == NOISE:
            teaser, prefixed, length = teaser and marked(i), prefixed or marked(i), length + marked(i)
    # nearest decided lines before and after each line, by one sweep in each direction
    ahead, following = [-1] * len(labels), -1
    for i in range(len(labels) - 1, -1, -1):
        ahead[i] = following
        following = i if labels[i] in (BODY, NOISE) else following
    out, previous = list(labels), -1
    for i, x in enumerate(labels):
        if x != OPEN:
            previous = i if x in (BODY, NOISE) else previous
            continue
        a, b = (labels[previous] if previous >= 0 else NONE), (labels[ahead[i]] if ahead[i] >= 0 else NONE)
        if a == b or NONE in (a, b):
            out[i] = a or b or BODY
        elif item(i):  # a list item goes with the body on either side
            out[i] = BODY
        else:  # a subhead stands before its paragraphs; a loose line nearer the noise is noise
            out[i] = BODY if b == BODY or i - previous < ahead[i] - i else NOISE
    return out


def label_lines(lines: list[str], title: str | None = None, cache: dict | None = None) -> list[int]:
    """BODY, NOISE or NONE (no letter) of every line of a page, without knowledge of its source."""
    return settle(looks(lines, title, cache))


def main_text(text: str, title: str | None = None, cache: dict | None = None) -> str:
    """The body lines of a page, joined by newlines."""
    lines = text.split("\n")
    return "\n".join(x for x, y in zip(lines, label_lines(lines, title, cache)) if y == BODY)
