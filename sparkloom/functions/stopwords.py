"""Frequent function words, for language scores and word lists (fixed values, by language)."""

WORDS = {
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einen einer es für haben hat im in ist kann mit nach nicht noch nur oder schon sein sich sie sind um und unter von vor war wenn werden wie wird zu zum zur über",
    "en": "a about after all also an and are as at be been but by can could for from had has have he her his if in into is it its more no not of on one or our out she so than that the their them then there they this to was we were what when which who will with would you",
    "es": "al algo ante así como con cuando de del desde donde el ella en entre era es esta este ha hasta hay la las le lo los me mi muy más ni no o para pero por que se ser si sin sobre son su sus también un una y ya",
    "fr": "ai au aussi aux avec ce cette comme dans de des donc du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y à été",
}
STOP = {k: v.split() for k, v in WORDS.items()}
ALL = sorted({w for v in STOP.values() for w in v})
