"""Closed vocabularies of the wildlife harvest tables.

Every table in this module holds fixed values: they must equal the published vocabulary for
results to be right. Order matters in the rule lists (the first match wins).
"""

from starslice.runtime import literal_rows

# pattern on the lower-case title, portion, is_subtotal, method, youth
DEER_TITLE_RULES = [
    (r"opening weekend", "opening_weekend", True, "firearm", False),
    (r"early antlerless", "early_antlerless", False, "firearm", False),
    (r"antlerless", "late_antlerless", False, "firearm", False),
    (r"early youth", "early_youth", False, "firearm", True),
    (r"late youth", "late_youth", False, "firearm", True),
    (r"urban", "urban", False, "firearm", False),
    (r"\bcwd\b", "cwd", False, "firearm", False),
    (r"alternative", "alternative_methods", False, "firearm", False),
    (r"archery", "archery", False, "archery", False),
    (r"november|fall (deer )?firearms report", "november", False, "firearm", False),
    (r"all firearms|firearm season|^firearms$", "all_firearms", True, "firearm", False),
    (r"managed hunt", "managed_hunts", False, "mixed", False),
    (r"grand total", "grand_total", True, "mixed", False),
]
TURKEY_TITLE_RULES = [
    (r"youth", "spring_youth", False, "mixed", True),
    (r"opening day", "spring_opening_day", True, "mixed", False),
    (r"first week", "spring_first_week", True, "mixed", False),
    (r"spring", "spring", False, "mixed", False),
    (r"fall.*firearm", "fall_firearms", False, "firearm", False),
    (r"archery", "fall_archery", False, "archery", False),
]
DEER_HEADERS = {"antlered buck": "class:antlered_buck", "button buck": "class:button_buck", "doe": "class:doe", "total": "total"}
SPRING_HEADERS = {
    "adult gobbler": "class:adult_gobbler", "bearded hen": "class:bearded_hen", "juvenile gobbler": "class:juvenile_gobbler",
    "adult hen": "class:adult_hen", "gobbler": "class:gobbler", "total": "total", "turkey total": "total",
    "public land": "extra:public_land", "crossbow": "extra:crossbow", "": "skip",
}
FALL_HEADERS = {
    "adult gobbler": "class:adult_gobbler", "adult gobblers": "class:adult_gobbler", "adult hen": "class:adult_hen",
    "adult hens": "class:adult_hen", "juvenile gobbler": "class:juvenile_gobbler", "juvenile gobblers": "class:juvenile_gobbler",
    "juvenile hen": "class:juvenile_hen", "juvenile hens": "class:juvenile_hen", "bearded hen": "class:bearded_hen",
    "total": "total", "county total": "total", "public land": "extra:public_land", "crossbow": "extra:crossbow", "": "skip",
}
# Titles of tables that repeat others, a list for each species.
DEER_SKIPPED_TITLES = r"top 5|all methods"
TURKEY_SKIPPED_TITLES = r"top \d+ counties|statewide high counties"
SKIPPED_TITLES = {"deer": DEER_SKIPPED_TITLES, "turkey": TURKEY_SKIPPED_TITLES}
SUMMARY_TITLES = r"season summary|other totals"
SUMMARY_CLASSES = ("antlered_buck", "button_buck", "doe")  # the columns of the summary box, before the total
GENERIC_CAPTIONS = ("all counties", "top 5 counties")
# phrase in a report header, column
EFFORT_HEADER_PHRASES = [
    (r"total harvest", "harvest"),
    (r"(?:harvested deer|deer harvested|harvest) per square mile", "harvest_per_sqmi"),
    (r"firearms hunters per square mile", "firearms_hunters_per_sqmi"),
    (r"archery hunters per square mile", "archery_hunters_per_sqmi"),
    (r"trips per kill \(firearms\)", "trips_per_kill_firearms"),
    (r"trips per kill \(archery\)", "trips_per_kill_archery"),
    (r"public land hunting acres", "public_land_acres"),
    (r"number (?:of )?public hunting areas", "public_areas"),
]
# extra spellings that only fill gaps in an alias table
EXTRA_ALIASES = {
    "carrol": "29033", "cedar": "29039", "mcdonald": "29119", "dekalb": "29063", "saint louis city": "29510",
    "st louis city": "29510", "sainte genevieve": "29186", "saint genevieve": "29186",
}
# layer, predicate on the lower-case properties of its source features
LAYER_FILTERS = {
    "interstates": "properties['rttyp'] = 'I'",
    "public_land": "CAST(properties['acreage'] AS DOUBLE) >= 1000 AND properties['public_site'] = 'Y'",
    "forest": "properties['forestname'] = 'Mark Twain National Forest'",
}
NOT_A_PLACE = ("", "unknown", "out of state")

PORTION_LABELS = {
    "archery": "Archery", "early_antlerless": "Early antlerless", "early_youth": "Early youth", "urban": "Urban",
    "november": "November firearms", "opening_weekend": "Opening weekend", "cwd": "CWD portion", "late_youth": "Late youth",
    "late_antlerless": "Late antlerless", "alternative_methods": "Alternative methods", "managed_hunts": "Managed hunts",
    "all_firearms": "All firearms", "grand_total": "Grand total", "spring_youth": "Spring youth", "spring": "Spring",
    "spring_opening_day": "Spring opening day", "spring_first_week": "Spring first week", "fall_firearms": "Fall firearms",
    "fall_archery": "Fall archery",
}
CLASS_LABELS = {
    "antlered_buck": "Antlered bucks", "button_buck": "Button bucks", "doe": "Does", "adult_gobbler": "Adult gobblers",
    "bearded_hen": "Bearded hens", "juvenile_gobbler": "Juvenile gobblers", "adult_hen": "Adult hens",
    "juvenile_hen": "Juvenile hens", "gobbler": "Gobblers (age unknown)",
}


def label_dimension(spark, labels: dict[str, str], key: str):
    """A small (key, label, sort_order) dimension in display order."""
    return literal_rows(spark, [(k, v, i) for i, (k, v) in enumerate(labels.items())], f"{key} string, label string, sort_order int")
