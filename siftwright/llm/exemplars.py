"""Labelled residue exemplars, one per line; ``#`` stands for any number, ``@any`` for up to three words that vary (a name, a part of the paper),
``@slot`` for an unfilled place, ``@trace`` for a line of a stack trace, ``@mash`` for words struck on the keyboard's home row."""

from __future__ import annotations

#: Instructions left from templates.
PLACES = """
TODO: write the @any
TODO: write @any
TODO: insert text here
TODO
TBD
TBA
Your @any goes here
Your @any here
Type the @any of your paper in this space
Type your @any here
Enter the @any here
Enter @any
Insert @any here
Insert @any
Insert the text of your @any here
Add your @any here
Add @any here
Put the @any here
Put your @any in this place
Write your @any here
Write the @any in this section
Fill in the @any
Fill in this section before submission
Replace this text with the @any
Replace this with your @any
Replace the text below with your own
This section is left for the author to complete
To be written
To be completed
To be completed by the author
To be added
To be filled in
To be determined
To be announced
Coming soon
Text to be supplied
Content to follow
Click here to enter text
Click or tap here to enter text
Delete this paragraph before submitting
Delete this text and type your @any
Author name
First author, second author
Name of the author
Title of the paper
Paper title
Abstract goes here
Section heading
Subsection heading
Department name of organization
Email address of the author
Keyword one, keyword two, keyword three
Placeholder text
This is a template
Hier Text eingeben
Titel hier einfügen
Texte à compléter
Insérer le texte ici
Insertar texto aquí
Escriba aquí el @any
Testo da inserire
请在此输入内容
在此处输入标题
"""

#: Filler sentences.
FILLER = """
This is dummy text
This is sample text
This is filler text
This text is only here to fill the page
Replace this paragraph with your own
Sample sentence for layout only
Sample text
Dummy text for layout
Nothing to read here, the text follows later
Some text here
Some more text
Text text text
More text
Random text
Blah blah blah
Foo bar baz
Test test test
The quick brown fox jumps over the lazy dog
Hello world
Ceci est un faux texte
Dies ist ein Blindtext
Esto es un texto de relleno
\\lipsum[#-#]
\\blindtext[#-#]
\\Blindtext
\\kant[#-#]
\\blinddocument
"""

#: Words of the classic filler; any mixture of them is filler.
FILLER_WORDS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
leo turpis felis risus porta lectus arcu cursus massa urna mauris eget vitae ornare vel nunc
"""

#: Error pages and their surroundings.
ERRORS = """
# Not Found
Not Found
Page not found
File not found
Document not found
Object not found
# Bad Request
Bad Request
# Unauthorized
Unauthorized
Authorization required
# Forbidden
Forbidden
# Method Not Allowed
# Request Timeout
Request timed out
Connection timed out
Connection refused
Connection reset by peer
# Gone
# Too Many Requests
Too many requests from your address
Rate limit exceeded
# Internal Server Error
Internal server error
Internal server error (ref #)
# Bad Gateway
Bad Gateway
# Service Unavailable
Service Unavailable
Service temporarily unavailable
# Gateway Timeout
Gateway Timeout
HTTP # returned by the @any
HTTP error #
HTTP status #
Error #: the service is busy
Error: failed to load the @any
Error establishing a database connection
Error while loading the @any
An error occurred while processing your request
An unexpected error has occurred
Download failed: upstream returned status #
Gateway timeout while fetching # @any
The page you asked for does not exist or was moved
The page you requested could not be found
The page you are looking for has been moved or deleted
The requested URL was not found on this server
The requested document is not available
The requested resource is not available
The server encountered an error and could not complete your request
The server is temporarily unable to service your request
The server did not respond in time
The @any is down for maintenance until # #
The site is down for maintenance
Scheduled maintenance in progress
This file is no longer available on this server
This item has been removed
This content is not available in your region
Fatal: query failed near line #, contact the operator
Fatal error: uncaught exception in @any on line #
Warning: undefined variable in @any on line #
Try again in # minutes
Please try again later
Please contact the administrator
Please confirm that you are a person before the full text is shown
Please verify you are human
Checking your browser before accessing the site
Complete the captcha to continue
Your subscription does not include this article
You do not have permission to view this page
You do not have access to this article
You must be logged in to view this page
Log in to continue
Sign in to read the full article
Sorry, we could not find that @any
Sorry, this page is not available
Oops
Oops, something went wrong
Something went wrong
Something went wrong on our side
Access denied
Access to this resource is denied
Your session has ended; sign in again
Your session has expired
Request blocked (rule #, id #)
Your request has been blocked
Unable to open # @any: no such object in the store
Unable to connect to the server
Unable to load the @any
Could not load the @any
Failed to fetch @any
No such file or directory
Interner Serverfehler #
Ein Fehler ist aufgetreten
Seite nicht gefunden (#)
Seite nicht gefunden
Datei nicht gefunden
Zugriff verweigert: bitte melden Sie sich an
Zugriff verweigert
Dienst vorübergehend nicht verfügbar
Service momentanément indisponible
Erreur # : page introuvable
Erreur interne du serveur
Une erreur est survenue
Accès refusé, votre session a expiré
El servidor no responde, inténtelo más tarde
Página no encontrada (error #)
Se ha producido un error
Error interno del servidor
Acceso denegado
Pagina non trovata
Accesso negato
Página não encontrada
# 页面不存在
服务器错误,请稍后再试
服务器内部错误 #
访问被拒绝,请重新登录
无法访问此页面
(c) the @any team
Report a problem
Contact the @any desk
Contact support
Powered by @any
Home | Browse | Help
Terms of use
Privacy policy
All rights reserved
Back to search
Back to home
Go to the home page
Menu Search Login
"""

#: Notices that scripts are required.
SCRIPTS = """
Please enable JavaScript to read this @any
Please enable JavaScript to continue
Please enable JavaScript
Please enable scripts in your browser
Please turn on JavaScript in your browser settings and reload the page
You need to enable JavaScript to run this app
You need a browser with scripts turned on to view @any
You must have JavaScript enabled to use this site
Your browser does not support JavaScript
Your browser does not run scripts, so the @any cannot start
Your browser is not supported
JavaScript is disabled in your browser
JavaScript is required
JavaScript is required to view this page
JavaScript must be enabled
JavaScript has been disabled
JavaScript is off
JS is off
JS is required
Scripts are disabled
Scripting is disabled - the @any cannot be loaded
Script blocked by the browser
noscript: @any are drawn in the browser, switch scripts on
The @any could not start because active content is blocked
This page requires JavaScript
This site requires JavaScript
This site works only with JavaScript enabled
This application requires JavaScript to be enabled
It looks like JavaScript is disabled
Figures and text will not appear
Without JavaScript this page cannot be displayed
Turn it on and reload
Enable it and reload the page
Cookies and JavaScript must be allowed to continue
Enable cookies to continue
Bitte aktivieren Sie JavaScript, um den @any zu lesen
Bitte aktivieren Sie JavaScript in Ihrem Browser
Diese Seite benötigt JavaScript
Ihr Browser führt keine Skripte aus
JavaScript ist deaktiviert
Ohne aktive Inhalte kann der @any nicht geladen werden
Veuillez activer JavaScript pour lire cet @any
Ce site nécessite JavaScript
JavaScript est désactivé dans votre navigateur
Les scripts sont bloqués, le texte ne peut pas être affiché
Active JavaScript para ver el @any
Este sitio requiere JavaScript
Es necesario habilitar JavaScript
Su navegador tiene los scripts desactivados
Questo sito richiede JavaScript
Abilita JavaScript per continuare
Este site requer JavaScript
请启用 JavaScript 以查看全文
浏览器未启用脚本,无法加载文档
请在浏览器中启用 JavaScript
"""

#: Kinds of which any mixture, in any number, is residue: filler words, and the marks that unfilled places, trace lines and keyboard mash become.
MIXTURES = {"words": " ".join(FILLER_WORDS.split()), "place": "@slot", "error": "@trace", "filler": "@mash"}


def labelled() -> list[tuple[str, str]]:
    """``(kind, text)`` of every exemplar."""
    kinds = (("place", PLACES), ("filler", FILLER), ("error", ERRORS), ("script", SCRIPTS))
    return [(kind, line) for kind, text in kinds for line in text.strip().split("\n")]
