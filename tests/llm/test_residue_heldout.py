"""Reworded residue that no exemplar spells, and prose that is none: figures of the README."""

import pytest

from siftwright.llm import exemplars, residue

#: Written after the exemplars; none is one of them.
RESIDUE = """
Insert abstract.
Insert title here
Insert the introduction here.
Add your conclusion here.
Add your figure caption here
Your affiliation goes here
Your subtitle goes here.
Your summary here
Type the acknowledgements of your paper in this space
Enter the keywords here
Enter your abstract here.
Put the discussion here
Write your introduction here.
Write the method in this section
Fill in the affiliation
Replace this text with the abstract of your paper
Replace this with your introduction.
Replace this text with your results
To be completed later
To be added soon.
TBD.
TODO: write the discussion
TODO: write related work
TODO
Text to follow
Click here to enter the abstract
Click or tap to enter text.
Delete this text and type your introduction
This section is to be written
Sample text goes here
This is sample text.
This is only dummy text
Some more sample text
Blah blah.
Test test
Lorem ipsum sit dolor
Ut enim ad minim lorem dolor
{{title}}
${ABSTRACT}
<AUTHOR NAME>
@@SUMMARY@@
[[conclusion]]
__TITLE__
Error 418: the service is overloaded
410 Gone
401 Unauthorized
400 Bad Request
408 Request Timeout
429 Too Many Requests
HTTP error 503
HTTP status 404
Error 500
Internal server error 500
404 - Page not found
Error: page not found
The page could not be found
The requested page was not found on this server.
The requested document could not be found on this server
The page you requested does not exist
The page you asked for has been moved or deleted
The server did not respond
The server is temporarily unavailable
The service is temporarily unavailable
Service unavailable, please try again later
Please try again in 5 minutes
Please try again later.
Too many requests, try again later
Request timed out.
Connection refused by the server
Your session has expired, please log in
Your session has expired; sign in again
Please log in to continue
You must be logged in to view this article
You do not have permission to view this article
You do not have access to this page
Access to this page is denied
Access denied.
Access forbidden
Sorry, this page could not be found
Sorry, something went wrong
Oops! Page not found
An unexpected error occurred
An error occurred while loading the page
Unable to load the document
Could not load the article
The site is under maintenance
Powered by quarto
Please contact the site administrator
Please enable JavaScript to view this page.
Please enable JavaScript and reload the page
Please enable JavaScript in your browser
Please turn on JavaScript to continue
You need to enable JavaScript to view this page
JavaScript is required to read this article
JavaScript is disabled. Please enable JavaScript.
JavaScript must be enabled to view the article
This document requires JavaScript
This page requires JavaScript to be enabled
Your browser does not support scripts
Scripts are disabled in your browser
Without JavaScript this document cannot be displayed
Este sitio requiere JavaScript habilitado.
Diese Seite benötigt aktiviertes JavaScript
Veuillez activer JavaScript dans votre navigateur
Fehler: Seite nicht gefunden
Erreur: page introuvable
Error: página no encontrada
""".strip().split("\n")

PROSE = """
The stochastic kernel converges whenever the lattice is bounded.
We enable the cavity by a second laser and view the spectrum on a browser of modes.
Access to the archive is described in the data statement of the collaboration.
The error of the estimate is 404 in the chosen units.
Error 503 as a robust filament
Why the spectrum dominates the error
Placeholder crystals and the bounded waveguide
Access denied: the stochastic operator of failed requests
The service time of a request is exponential and the server is never idle.
Not found in the catalogue are the twelve faintest galaxies of the sample.
A gateway between two phases opens at the critical temperature.
This is a sample of stars.
We test the test statistic on a test set of galaxies.
The text of the theorem follows from the lemma.
Here we write the Hamiltonian in the rotating frame.
The title compound was synthesised in two steps.
To be complete, a space needs every Cauchy sequence to converge.
The page rank of the graph is computed in time linear in its edges.
Please see the appendix for the proof.
The script of the simulation is available on request.
Forbidden transitions of the ion are listed in Table 2.
Internal server load is balanced by the queue discipline of section 3.
Session types guarantee that a protocol does not deadlock.
JavaScript engines compile hot loops to machine code.
The magnetic dolorimeter of the labor group measures pain thresholds.
""".strip().split("\n")


def kind(line):
    found = residue.Index().residue(f"\\documentclass{{article}}\n\\title{{On kernels}}\n\\begin{{document}}\n\\section{{Method}}\n{line}\n\\end{{document}}\n")
    return found and found[1]


def test_recall_of_reworded_residue():
    assert len(RESIDUE) >= 100 and not {x.rstrip(".").lower() for x in RESIDUE if "{" not in x and "TODO" not in x} & {t.lower() for _, t in exemplars.labelled() if "@" in t}
    missed = [x for x in RESIDUE if not kind(x)]
    print(len(missed), "of", len(RESIDUE), "missed:", missed)
    assert len(missed) <= 0.1 * len(RESIDUE)


@pytest.mark.parametrize("line", PROSE)
def test_prose_is_none(line):
    assert kind(line) is None
