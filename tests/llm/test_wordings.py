"""Refusals and answers in another language in wordings that the templates and word lists were not written from: written down afterwards, measured, not fitted to."""

from marlstone.llm import pairs_quality, refusals

REFUSED = """
Sorry, that is something I have no way of helping with.
Unfortunately I lack the data needed to say.
I'd prefer to skip this one.
I'm afraid I can't work that out.
We are not in a position to give an answer.
That is beyond my abilities.
I have no idea how to solve it.
I'm not comfortable answering that.
My programming prevents me from replying.
I don't have access to the paper.
I can't provide the requested value.
There isn't enough information for me to respond.
I must politely decline.
I'll pass on this question.
I am unable to assist you further.
Sorry, no answer from me.
This prompt was blocked.
Company policy forbids discussing this topic.
I really cannot tell.
It would be better to consult an expert.
I refuse.
I do not possess the required knowledge.
We regret that we cannot process this request.
I shall not comment on this problem.
Not able to help here.
Das kann ich dir leider nicht sagen.
Ich bin nicht befugt, darauf zu antworten.
Hierzu liegen mir keine Informationen vor.
Ich möchte diese Aufgabe nicht bearbeiten.
Leider fehlt mir das nötige Wissen.
Das darf ich nicht beantworten.
Ich muss hier passen.
Je ne suis pas autorisé à fournir cette information.
Malheureusement, je ne sais pas répondre.
Je refuse de traiter ce problème.
Je ne dispose pas des informations nécessaires.
Désolé, je ne peux rien dire.
Lo siento, no tengo esa información.
No me es posible contestar.
Me niego a responder.
No estoy en condiciones de ayudar.
Non posso aiutarti con questo.
Preferisco non rispondere.
Não consigo responder a isso.
Ik kan deze vraag niet beantwoorden.
""".strip().splitlines()
ANSWERED = """
The value cannot be smaller than $5$, so it is $5$.
There is no such group.
We cannot have two fixed points, hence the answer is $1$.
No, since the map is not injective.
I is the identity matrix and it does not commute with $A$.
It is not possible to colour the graph with two colours, so the chromatic number is $3$.
Unable to be extended, the section is trivial; its degree is $0$.
The answer is unknown to the first player until step $4$.
We reject the null hypothesis at level $0.05$.
The request queue holds $12$ entries.
The policy gradient does not vanish; its norm is $2$.
Unfortunately the bound is not sharp: the true value is $7$.
One can not do better than $n/2$.
The scheduler refuses new jobs once $k$ exceeds $10$.
No answer key is needed: the sum telescopes to $1$.
The help of a lemma gives $\\\\chi = 4$.
It lies outside the unit disc, so the series diverges.
The defendant declined to testify; the verdict was $3$ to $2$.
The prompt neutrons number $14$.
We are given that $x$ is not in $K$; thus $x = 2$.
We must not divide by zero, so $n = 1$ is excluded and $n = 2$ remains.
We know that no prime divides both, so the gcd is $1$.
The model has no parameters that are not identified; there are $6$.
As an operator on $V$ it is not able to separate points.
Es gibt keine solche Lösung.
Der Wert kann nicht größer als $3$ sein.
Man kann die Menge nicht weiter zerlegen, ihre Ordnung ist $4$.
Die Reihe ist nicht konvergent.
Das Gericht lehnte die Klage ab; es gab $2$ Stimmen dagegen.
Il n'existe pas de telle solution.
La suite ne peut pas être bornée.
On ne peut pas faire mieux que $7$.
La constante n'est pas nulle et vaut $2$.
No existe tal solución.
El valor no puede ser mayor que $4$.
La serie no es convergente.
Non esiste una tale soluzione.
Il valore non può superare $3$.
Não existe tal solução.
Er is geen oplossing.
""".strip().splitlines()
OTHER = """
Existuje právě 12 takových řešení, protože řád je roven 4.
Hodnota je rovna 7, ale nezávisí na volbě báze.
Det finns exakt 15 sådana lösningar och de är alla reella.
Värdet är lika med 3 eftersom ordningen är 9.
Tam olarak 14 çözüm vardır çünkü mertebe 6 ve bu bir grup.
Aranan değer 5 olarak bulunur, çünkü her sınıf için aynıdır.
Der er præcis 8 løsninger, og de er ikke reelle.
Det finnes nøyaktig 8 løsninger, og det er ikke flere.
On olemassa täsmälleen 11 ratkaisua, koska kertaluku on 4 ja se on parillinen.
Pontosan 9 megoldás van, mert az érték nem nulla.
Există exact 7 soluții, pentru că ordinul este 5.
Існує рівно 12 таких розв'язків, тому що порядок дорівнює 4.
Υπάρχουν ακριβώς 5 λύσεις, γιατί η τάξη είναι 3.
Er zijn precies 6 oplossingen omdat de orde 4 is.
Existem exatamente 9 soluções, porque a ordem é igual a 4.
Ada tepat 5 solusi untuk persamaan ini karena ordenya adalah 4.
Có đúng 5 nghiệm vì bậc là 4 và không có nghiệm khác.
정확히 다섯 개의 해가 있다.
ちょうど5個の解がある。
يوجد بالضبط خمسة حلول.
Die Ordnung beträgt genau 4, also gibt es zwei.
La réponse est le nombre de classes, soit 12.
La respuesta es el número de clases.
La risposta è il numero delle classi.
""".strip().splitlines()
SAME = """
The order is 4.
It is the trivial group.
Exactly 12 classes.
It equals the index of $H$ in $G$, i.e. 6.
Two, en route to the fixed point.
The de Rham class is zero.
A la carte bound: 3 at most.
There are 7, as in the case of a torus.
The Lie bracket vanishes in $V$.
Die-roll entropy of the model is 2 bits.
Both; see the lemma.
Van der Waals energy of the gas.
Von Neumann entropy is 1.
Rank: 5 in E.
The sum over i and j is 9.
""".strip().splitlines()
QUESTION = "How many of the solutions are fixed by the map, and what is the order of the group that they form?"


def found(texts, test):
    return [t for t in texts if test(t)]


def measured():
    """(recall, precision) of refusals and of answers in another language."""
    other = lambda t: pairs_quality.other_language(QUESTION, t)
    out = {}
    for name, true, false, test in (("refusal", REFUSED, ANSWERED, refusals.refuses), ("other_language", OTHER, SAME + ANSWERED[:24], other)):
        hit, wrong = found(true, test), found(false, test)
        out[name] = len(hit) / len(true), len(hit) / max(1, len(hit) + len(wrong)), [t for t in true if t not in hit], wrong
    return out


def test_wordings_not_seen():
    for name, (recall, precision, missed, wrong) in measured().items():
        assert recall >= 0.8 and precision >= 0.9, (name, recall, precision, missed, wrong)
