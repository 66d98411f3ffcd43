"""Seed texts, written for this project, from which the character models of p10 are fitted."""

from __future__ import annotations

import random
import re

FIELDS = """first name|last name|full name|customer name|customer.name|customer number|order total|order number|order id|ticket id|ticket number|due date|start date|end date
|agent signature|agent.signature|agent name|meeting start|meeting.start|meeting room|mailbox|company|company name|sender|sender name|recipient|user name|user email|account id|account number
|invoice number|invoice amount|product name|support phone|your name|your company|subject line|delivery date|address line|city|reset link|unsubscribe link|street|postal code
|vorname|nachname|kundenname|kundennummer|firma|firmenname|absender|datum|betrag|bestellnummer|ticketnummer|anrede|ihr name|frist|unterschrift
|prénom|nom du client|numéro de commande|société|expéditeur|date d'échéance|montant|votre nom|objet
|nombre|apellido|nombre del cliente|número de pedido|empresa|remitente|fecha límite|importe|su nombre|asunto""".replace("\n", "").split("|")

NOTES = """see note|see notes|see page|see above|siehe anmerkung|voir note|véase nota|update|updated|edit|edited|note|i|ii|iii|sic|ext|external|extern|externe|fwd|re|b|p|br|li|td|div|span|a|u|em|strong|href|http|https
|home|path|temp|tmp|user|userprofile|appdata|endoftext|startoftext|sep|cls|mask|pad|unk|ok|id|true|false|null|list|string|int|x|y|n|draft|closed|open|solved|resolved|info|warn|error|debug""".replace("\n", "").split("|")

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """the a an of to in on at by for with from and or but that which who is are was were be been has have had not no this it its we you he she they i my your our once if when then
der die das den dem des ein eine einen einem und oder aber dass ist sind war wird wurde hat haben nicht kein im am zum zur von mit bis auf für ohne noch sich bitte wir ihr sie es ich zu
le la les l un une des du de et ou mais que qui est sont a ont pas ne ce cette dans sur par pour avec sans il elle nous vous y en au aux d
el los las una unos y o pero es son ha han no se lo su sus con sin por para del al en desde antes hay que""".split()
)

ERROR = """404 Not Found
404 - Page not found
The requested page was not found on this server.
The page you are looking for does not exist or has been moved.
403 Forbidden
Access denied
You do not have permission to open this page. Contact your administrator.
You are not authorised to view this resource.
401 Unauthorized
500 Internal Server Error
Internal server error. Please try again later.
Error 500: the server could not answer. Request id 8f2a90. Please try again later.
Error 502: bad response from upstream.
502 Bad Gateway
Bad gateway
The upstream server dropped the connection before it replied.
503 Service Unavailable
You do not have permission to open /docs/7 on this server. Reference 1182
Access denied
Something broke at our end. We have been told about it.
Service unavailable. We are under maintenance and expect to return at noon.
The service is temporarily unavailable. Please try again in a few minutes.
This site is down for maintenance.
504 Gateway Timeout
The gateway did not receive a timely response. Support id 38221
408 Request Timeout. The connection has timed out.
The request timed out.
429 Too many requests. Slow down.
You have made too many requests. Wait and retry.
Your session has ended because of inactivity. Sign in once more.
Session expired. Log in again.
Your login has timed out, please sign in.
This link has expired.
Something went wrong. Please reload the page.
Oops! Something went wrong on our end.
An unexpected error occurred. Reference 77ab12c0
An error occurred while processing your request.
We could not load this message. Try again.
Could not connect to database.
Connection refused
Fatal error: Uncaught exception in /var/www/html/index.php on line 41
  File "/srv/app/mail/views.py", line 88, in render
    value = context[key]
KeyError: 'subject'
ValueError: invalid literal for int()
TypeError: 'NoneType' object is not subscriptable
AttributeError: object has no attribute 'body'
NullPointerException
Exception in thread "main" java.lang.NullPointerException
    at com.mail.index.Reader.open(Reader.java:120)
Segmentation fault (core dumped)
Error code: 0x80070005
HTTP Error 404. The requested resource is not found.
Fehler 404
Fehler 404 - Seite nicht gefunden
Die Seite wurde nicht gefunden.
Die angeforderte Seite existiert nicht mehr. Vorgang 7710
Wir konnten die aufgerufene Seite nicht finden.
Zugriff verweigert
Zugriff verweigert. Sie haben keine Berechtigung für diese Seite.
Interner Fehler des Servers
Interner Serverfehler (500). Bitte später erneut versuchen.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
Dienst nicht erreichbar. Wartungsarbeiten bis 7:30 Uhr.
Zeitüberschreitung bei der Anfrage.
Zeitüberschreitung: der Server antwortet nicht. Code 8812
Ihre Sitzung wurde wegen Inaktivität beendet. Melden Sie sich neu an.
Die Sitzung ist abgelaufen, bitte neu anmelden.
Ein unerwarteter Fehler ist aufgetreten.
Zu viele Anfragen. Bitte warten Sie einen Moment.
Erreur 404
Erreur 404 : cette page n'existe pas ou plus. Réf. 7710
Page introuvable
La page demandée est introuvable.
Accès refusé
Accès refusé. Vous n'avez pas les droits pour ouvrir cette page.
Erreur interne du serveur
Erreur interne du serveur (500). Veuillez réessayer plus tard.
Le service ne répond pas pour le moment (503).
Service temporairement indisponible, veuillez réessayer plus tard.
Délai d'attente dépassé
Le délai de réponse est dépassé. Veuillez réessayer.
Session expirée : reconnectez-vous pour continuer.
Une erreur est survenue. Veuillez recharger la page.
Trop de requêtes. Veuillez patienter.
Error 404
Error 404. La página que busca no existe.
Página no encontrada
No se ha encontrado la página solicitada.
Acceso denegado
Acceso denegado. No tiene permiso para ver esta página.
Fallo interno del servidor
Error interno del servidor, código 500. Inténtelo de nuevo más tarde.
Servicio no disponible. Inténtelo más tarde.
Servicio no disponible por mantenimiento hasta las 7:30.
Tiempo de espera agotado
Se agotó el tiempo de espera de la solicitud.
Su sesión ha terminado por inactividad; identifíquese otra vez.
La sesión ha expirado, vuelva a iniciar sesión.
Se ha producido un error inesperado.
Demasiadas solicitudes. Espere un momento.""".split("\n")

SCRIPT = """Please turn on JavaScript to see this page.
Please enable JavaScript to continue.
Please enable JavaScript and cookies in your browser.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. Some parts of the site will not load.
JavaScript is required to use this site.
This page requires JavaScript. Turn it on and reload.
The application runs on scripts, which your browser has switched off. Switch them on and load the page again.
Your browser does not support JavaScript.
Your browser does not run scripts or they are blocked; the page cannot be displayed.
Scripts are blocked. Allow scripts to see the content.
No scripts here: activate scripting and refresh.
Enable scripting and reload this page.
Scripts are disabled: the message cannot be displayed.
Scripts are required to show this message.
Für die Anzeige dieser Seite werden Skripte benötigt.
Skripte sind deaktiviert; die Nachricht kann nicht angezeigt werden.
Les scripts sont désactivés : la page ne peut pas être affichée.
Les scripts sont requis pour afficher ce contenu.
Los scripts están desactivados: no se puede mostrar la página.
Se necesitan scripts para mostrar este contenido.
Bitte schalten Sie JavaScript ein, damit die Seite angezeigt wird.
Bitte JavaScript aktivieren.
JavaScript ist in Ihrem Browser deaktiviert. Die Seite kann nicht angezeigt werden.
Diese Anwendung benötigt JavaScript. Bitte schalten Sie es ein und laden Sie neu.
Diese Seite braucht Skripte; bitte im Browser erlauben und neu laden.
Ihr Browser führt keine Skripte aus.
Merci d'activer JavaScript pour voir le contenu.
JavaScript est désactivé dans votre navigateur.
Cette application a besoin de scripts ; activez-les puis rechargez.
Cette page nécessite JavaScript. Activez-le et rechargez.
Votre navigateur n'exécute pas les scripts.
Active JavaScript en su navegador para ver el contenido.
Debe habilitar JavaScript para ver esta página.
JavaScript está desactivado en su navegador.
La aplicación funciona con scripts: permítalos y cargue la página otra vez.
Esta página requiere JavaScript. Actívelo y vuelva a cargar.
Su navegador no ejecuta scripts.""".split("\n")

_LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi
ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt
mollit anim id est laborum pondus gravis rivus nunquam lectus altus porta celer mercis tempora sapiens vela ferrum novus tantus aequor lumen tellus vitae mauris ornare faucibus pulvinar vestibulum""".split()

FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Lorem ipsum dolor sit amet
Lore ipsum 1
This is placeholder copy for the section. Replace this paragraph with your own words.
This is placeholder text. Replace it with your own content.
Replace this text with your own.
Put your heading in this place.
Write your own words over this line.
Insert text here
Type your content here
Sample text sample text sample text
Headline 1
Headline 2
Subheading 1
Section title 3
Item 1
Item 2
Item 5
Bullet point 2
TODO write this 1
TODO write this
TODO: fill in
TBD 1
TBD
TBD TBD TBD
To be written 2
Content coming soon.
Coming soon
foo bar baz foo bar baz
asdf asdf asdf asdf
qwerty qwerty qwerty qwerty
n/a n/a n/a n/a
aaa aaa aaa aaa
... ... ... ...
--- --- --- ---
Hier steht ein Blindtext für den Abschnitt. Bitte durch eigenen Text ersetzen. Überschrift hier einfügen.
Dies ist ein Platzhaltertext. Ersetzen Sie ihn durch Ihren Inhalt.
Blindtext Blindtext Blindtext
Hier Text einfügen
Ceci est un texte de remplissage pour la section. Remplacez ce paragraphe par le vôtre. Insérez un titre ici.
Texte provisoire à remplacer par votre contenu.
Votre texte ici
Faux texte faux texte faux texte
Este es un texto de relleno para la sección. Sustituya este párrafo por el suyo. Inserte aquí un título.
Texto provisional; reemplácelo por su contenido.
Su texto aquí
Texto de prueba texto de prueba""".split("\n")

#: Sentences that speak about residue or quote it: never residue.
TALK = """The server answered with error 404 again on Monday, so the team moved the page.
The portal answered with error 500 twice on 7 March, and the help desk looked into it.
Users asked why the page said that their session had expired; the answer is in the guide.
A customer wrote that the portal refused to open the report for her team.
Error 503 means that the service is unavailable; it is explained in the manual.
The designers used lorem ipsum in the first draft, which has since been replaced.
We replaced the filler text in the brochure last week.
The TODO list was finished before lunch.
To add a name to a mail merge, type in the template; the tool fills it in when it sends.
Write the field name between double braces in the template and the tool replaces it.
In the shell guide the line cp is quoted as an example for the table.
For example, the variable is replaced by the home folder when the script runs.
The placeholder is filled in when the mail is sent.
Scripts must be switched on for the calendar add-on, so the office will change the policy.
The policy says that JavaScript stays disabled on shared machines, as agreed.
The set and the record were cancelled behind the canteen.
The help page explains what to do when the browser blocks scripts.
Der Server meldete am Montag zweimal den Fehler 500, das Team hat ihn behoben.
Die Anleitung erklärt, was die Meldung auf der Seite bedeutet.
Im ersten Entwurf stand noch Blindtext, der inzwischen ersetzt wurde.
In der Vorlage schreibt man das Feld in doppelte Klammern, zum Beispiel so.
Für das Kalendermodul müssen Skripte eingeschaltet sein, daher ändert die Technik die Regel.
Le serveur a renvoyé deux fois l'erreur 500 lundi, l'équipe l'a corrigée.
Le guide explique ce que signifie le message de la page.
La première maquette contenait du faux texte, remplacé depuis.
Dans le modèle, on écrit le champ entre accolades, par exemple ainsi.
Les scripts doivent être activés pour le module calendrier, donc le bureau changera la règle.
El servidor respondió dos veces con el error 500 el lunes y el equipo lo corrigió.
La guía explica qué significa el mensaje de la página.
El primer borrador llevaba texto de relleno, que ya se ha sustituido.
En la plantilla se escribe el campo entre llaves, por ejemplo así.
Los scripts deben estar activados para el complemento de calendario, así que la oficina cambiará la norma.""".split("\n")

#: Lines of navigation, greetings and references that stand beside residue and prose alike.
NEUTRAL = """Start | News | Contact
Menu
Inbox
Settings
Skip to content
Privacy | Terms
Loading...
© 2024 Company
Hello everyone,
Hi all,
Dear team,
Hallo zusammen,
Sehr geehrte Damen und Herren,
Bonjour à tous,
Hola a todos,
Best regards,
Mit freundlichen Grüßen
Cordialement,
Un saludo,
Thank you for your help.
v2.6.2 (17.01.2024)
v7.18.0 (12 July)
1. first
2. second
| a | b | c |
# Parking
[Update] Noted.
Support id 10482
Request id 9a1c44de
Reference 1182
Ref. 7710
Code 8812""".split("\n")


def pseudo_latin(count: int = 400, seed: int = 7) -> list[str]:
    """Pseudo-Latin sentences, of known words and of stems with Latin endings."""
    rng = random.Random(seed)
    stems = [a + b + c for a in ("", "c", "d", "f", "gr", "l", "m", "n", "p", "qu", "r", "s", "t", "v") for b in "aeiou" for c in ("l", "lt", "m", "mp", "nd", "nt", "pid", "r", "rc", "rr", "rt", "ct", "s", "v", "ll")]
    made = [rng.choice(stems) + rng.choice(("a", "o", "um", "us", "is", "am", "em", "at", "it", "or", "ora", "era", "ide")) for _ in range(600)]
    return [" ".join(rng.choice(_LATIN if rng.random() < 0.7 else made) for _ in range(rng.randint(4, 16))).capitalize() + "." for _ in range(count)]


def key_runs(count: int = 60, seed: int = 11) -> list[str]:
    """Runs of neighbouring keys of common keyboards."""
    rng = random.Random(seed)
    rows = ("asdfghjkl", "asdfjklöä", "qwertzuiop", "qwertyuiop", "sdfjkl", "qwerasdf")
    return [" ".join("".join(rng.choice(keys) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(4, 14))) for keys in rows for _ in range(count)]


def repeats(count: int = 12, seed: int = 13) -> list[str]:
    """A stand-in word over and over."""
    rng = random.Random(seed)
    words = "xxx yyy zzz aaa text dummy test blah bla sample content word filler abc la muster prueba essai relleno".split()
    return [" ".join([w] * rng.choice((3, 4, 8, 9, 10, 12, 15))) for w in words for _ in range(count)]


#: Grammars of messages in common use, '{a|b}' for a choice, from which the seeds are drawn beside the lines above.
_CODE = "{400|401|403|404|408|410|429|500|502|503|504}"
_REASON = "{400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|408 Request Timeout|410 Gone|429 Too Many Requests|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout}"
_MARK = "{|||. Reference 1182|. Request id 8f2a90c1|. Ref. 7710b2|. Support id 38221|. Code 8812| (site.example)}"
ERROR_GRAMMARS = [
    f"{{{{{_REASON}|Error {_CODE}|HTTP {_CODE}|Service unavailable|Page not found|Access denied|Forbidden|Server error|Request timed out|Session expired}}{{|.}}|{_REASON}{_MARK}}}",
    f"{{{_REASON}. |Error {_CODE}: |||}}The {{|requested }}{{page|resource|file|address|document}} {{|you are looking for |you asked for |you requested }}{{was not found|could not be found|does not exist|has been moved or deleted|is no longer available|is gone}}{{| on this server}}.{_MARK}",
    f"{{Error {_CODE}: |||}}{{Something|Oops, something|Sorry, something}} went wrong{{| on our side| on our end| here}}.{{| Please {{try again|reload the page|come back}} {{later|in a moment|in a few minutes}}.}}{_MARK}",
    f"{{{_REASON}. |Error {_CODE}: |||}}The {{server|service|site|application|upstream host|gateway|database}} {{is temporarily unavailable|is down for maintenance|did not answer in time|is overloaded|closed the connection|met an unexpected error|cannot be reached|sent a bad response}}{{|, back at 7:30| until 18:00}}{{. Please try again later||}}.{_MARK}",
    f"{{Access denied. |{_REASON}. ||}}You {{do not have permission|are not authorised|are not allowed|need a login}} to {{open|view|see|access|use}} {{this page|this resource|this folder|/docs/7|this report}}.{{| Ask your administrator.}}{_MARK}",
    f"Your {{session|login|link|token|access}} {{has expired|expired|has timed out|is no longer valid}}{{.|. Please {{sign in|log in|log on}} again{{| to continue}}.|; sign in again.}}{_MARK}",
    f"{{Fehler {_CODE}: |||}}Die {{|gewünschte |angeforderte |aufgerufene |gesuchte }}{{Seite|Datei|Adresse|Anwendung}} {{wurde nicht gefunden|existiert nicht mehr|existiert nicht|ist nicht verfügbar|konnte nicht geladen werden}}.{{||| Vorgang 5512| Code 8812}}",
    f"{{Fehler {_CODE}: |||}}{{Der Server|Der Dienst|Die Anwendung|Das Portal}} {{ist vorübergehend nicht erreichbar|antwortet nicht|ist wegen Wartung nicht verfügbar|ist überlastet|hat einen unerwarteten Fehler gemeldet}}{{|. Bitte versuchen Sie es später erneut|. Bitte später noch einmal versuchen}}.{{||| Vorgang 5512}}",
    "{Zugriff verweigert|Kein Zugriff|Interner Serverfehler|Serverfehler|Seite nicht gefunden|Zeitüberschreitung|Dienst nicht verfügbar|Sitzung abgelaufen}{|. Sie haben keine Berechtigung, diese Seite zu {öffnen|sehen}.|. Bitte {später erneut versuchen|neu laden}.|.}{||| Vorgang 5512}",
    "{Ihre|Die} {Sitzung|Anmeldung} ist {abgelaufen|nicht mehr gültig}{.|. Bitte {melden Sie sich erneut an|melden Sie sich neu an|neu anmelden}.|, bitte neu anmelden.}",
    f"{{Erreur {_CODE} : |||}}{{La page|La ressource|L'adresse}} {{|demandée |recherchée }}{{est introuvable|n'existe pas|n'existe plus|n'est plus disponible|n'a pas été trouvée}}.{{||| Réf. 7710| Code 8812}}",
    f"{{Erreur {_CODE} : |||}}{{Le serveur|Le service|Le site}} {{est temporairement indisponible|ne répond pas|est en maintenance|a rencontré une erreur inattendue}}{{|. Veuillez réessayer plus tard|, veuillez réessayer plus tard}}.{{||| Réf. 7710}}",
    "{Accès refusé|Accès interdit|Erreur interne du serveur|Service indisponible|Page introuvable|Délai dépassé|Session expirée}{|. Vous n'avez pas {le droit|les droits|l'autorisation} {d'ouvrir|de consulter|de voir} cette page.|. Veuillez réessayer.|.}{||| Code 503| Réf. 7710}",
    "{Votre|La} session {a expiré|est expirée|n'est plus valide}{.|, veuillez vous {reconnecter|identifier à nouveau}.|. Reconnectez-vous.}",
    f"{{Error {_CODE}: |||}}{{|No encontramos |No se encuentra |No se ha encontrado |No existe }}la {{página|dirección|aplicación}} {{solicitada|pedida|buscada|}}.{{||| Ref. 7710| Código 8812}}",
    f"{{Error {_CODE}: |||}}{{El servidor|El servicio|El sitio}} {{no está disponible|no responde|está en mantenimiento|ha tenido un error inesperado}}{{|. Inténtelo de nuevo más tarde|. Inténtelo más tarde}}.{{||| Ref. 7710}}",
    "{Acceso denegado|Acceso prohibido|Error interno del servidor|Servicio no disponible|Página no encontrada|Tiempo agotado|Sesión caducada}{|. No tiene {permiso|autorización} para {abrir|ver} esta página.|. Inténtelo más tarde.|.}{||| Código 503| Ref. 7710}",
    "{Su|La} sesión ha {caducado|expirado|terminado}{.|. Inicie sesión {de nuevo|otra vez}.|, vuelva a iniciar sesión.}",
]
FILLER_GRAMMARS = [
    "{Your|Some|The|More} {copy|content|title|heading|words|caption|description|body text|summary} {goes|go|comes|belongs} {here|in here|in this place|below}.",
    "{Put|Write|Insert|Type|Enter|Place|Add} {your|some|the} {copy|content|title|heading|words|text|caption|headline|summary} {here|in here|in this place}.",
    "{Item|Point|Entry|Row|Headline|Section|Title|Bullet|Paragraph|Step|Punkt|Eintrag|Élément|Elemento} {1|2|3|7|12}",
    "{Hier|An dieser Stelle} {steht|folgt|kommt} {Ihr Text|der Inhalt|eine Überschrift|ein Blindtext|Ihr Titel}.",
    "{Votre|Un} {texte|titre|contenu|résumé} {va ici|vient ici|se place ici|à insérer ici}.",
    "{Su|Un} {texto|título|contenido|resumen} {va aquí|irá aquí|se escribe aquí}.",
]
SCRIPT_GRAMMARS = [
    "{Please|You need to|You must|To continue,} {enable|turn on|switch on|allow|activate} {JavaScript|scripts|scripting}{| in your browser} {to {view|see|read|use|open} {this page|this site|this app|the content|this message|the mailbox}|and {reload|refresh|load} {the page|this page}|to continue}.",
    "{JavaScript|Scripts|Scripting} {is|are} {disabled|required|needed|blocked|switched off|turned off}{| in your browser}{.|. {Turn it on|Enable it|Allow them} and {reload|try again}.|; the {page|message|mailbox} cannot be {shown|displayed}.}",
    "{This|The} {app|page|site|mailbox|viewer} {needs|requires|uses|does not work without} {JavaScript|scripts}{| to run}. {Turn {it|them} on|Enable {it|them}|Please allow {it|them}}{| in your browser} and {reload|press reload|try again}.",
    "{noscript: |Noscript: ||}{activate|enable|allow} {scripting|scripts|JavaScript}, then {press reload|reload|reload the page}{.|}",
    "{Bitte|Sie müssen} {aktivieren Sie |schalten Sie |}{JavaScript|Skripte}{| im Browser}{ ein|}{, um {diese Seite|den Inhalt|die Anwendung} zu {sehen|öffnen|nutzen|lesen}|, damit die Seite angezeigt wird| aktivieren| und laden Sie die Seite neu}.",
    "{JavaScript ist|Skripte sind} {deaktiviert|erforderlich|nötig|ausgeschaltet|blockiert}{| in Ihrem Browser}{.|. {Bitte {einschalten|aktivieren|erlauben} und neu laden|Schalten Sie {es|sie} ein}.}",
    "{Diese|Die} {Seite|Anwendung|Ansicht} {benötigt|braucht|erfordert|nutzt} {JavaScript|Skripte}{.|; bitte {im Browser erlauben|einschalten} und neu laden.|. Bitte aktivieren.}",
    "{Veuillez|Merci de|Vous devez} {activer|autoriser|débloquer} {JavaScript|les scripts}{| dans votre navigateur} {pour|afin de} {afficher|voir|lire|utiliser|ouvrir} {cette page|ce site|ce contenu|cette application|le message}.",
    "{JavaScript est|Les scripts sont} {désactivé|désactivés|requis|nécessaires|bloqués}{| dans votre navigateur}{.| pour afficher {cette page|ce contenu}.|. {Activez-les|Activez-le} puis rechargez.}",
    "{Cette|La} {page|application|vue} {nécessite|a besoin de|demande|utilise} {JavaScript|scripts}{.| ; activez-les puis rechargez.|. Activez-le et rechargez la page.}",
    "{Active|Debe activar|Habilite|Debe habilitar|Permita} {JavaScript|los scripts}{| en su navegador} para {ver|usar|leer|abrir} {esta página|este sitio|el contenido|esta aplicación|el mensaje}.",
    "{JavaScript está|Los scripts están} {desactivado|desactivados|bloqueados}{| en su navegador}{.|. {Actívelo|Actívelos} y {recargue|vuelva a cargar}.}",
    "{Esta|La} {página|aplicación|vista} {requiere|necesita|usa} {JavaScript|scripts}{.|; {habilítelos|actívelos} y recargue.|. Actívelo y vuelva a cargar la página.}",
]


def drawn(grammars: list[str], count: int = 40, seed: int = 19) -> list[str]:
    """`count` sentences of each grammar."""
    rng, choice, out = random.Random(seed), re.compile(r"\{([^{}]*)\}"), []
    for grammar in grammars:
        for _ in range(count):
            text = grammar
            while "{" in text:
                text = choice.sub(lambda m: rng.choice(m.group(1).split("|")), text)
            text = " ".join(text.split()).replace(" .", ".").replace("..", ".")
            out.append(text[:1].upper() + text[1:])
    return out
