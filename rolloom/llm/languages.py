"""Frequent words by which the language of a text is told."""

from __future__ import annotations

# Frequent words of each language.
FREQUENT = {
    "en": "the of and to is in that for with by from are this at then every which be an has only when into its what we so".split(),
    "de": "der die und das den dem ist von mit sich ein eine einer auf für nicht wird bei so man durch ergibt oder als wir also".split(),
    "fr": "le la les et des du est une un que pour dans par sur au aux avec qui pas sont on cette ce se donc".split(),
    "es": "el los las y del es una un que para en por con se al lo como más si esta este sobre entre su así".split(),
    "it": "il lo gli e di del della è una un che per in con si al non come più se questo ma ogni poiché dunque restano".split(),
    "pt": "o os as e do da dos é uma um que para em por com se ao não como mais este isso mas cada pois logo são".split(),
    "nl": "de het een en van is dat met voor op niet zijn wordt bij als door dus dan ook elke".split(),
    "pl": "i w z na do się jest nie że to jak dla przez więc oraz każdy".split(),
}
