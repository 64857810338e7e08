"""Parameter tables whose values are fixed: defaults of the operators that take them as arguments."""

from __future__ import annotations

# The regions of countries; any other country is in region "Other".
REGION_COUNTRIES = {
    "Europe": (
        "United Kingdom, Switzerland, Germany, Sweden, Belgium, France, Netherlands, Denmark, Finland, Norway, Spain, Ireland, Austria, "
        "Italy, Russian Federation, Czechia, Greece, Portugal, Cyprus, Poland, Iceland, Hungary, Luxembourg, Estonia, Romania, Slovenia, "
        "Malta, Lithuania, Latvia, Ukraine, Serbia, Slovakia, Croatia, Bulgaria, North Macedonia, Bosnia and Herzegovina, Kosovo"
    ),
    "North America": "United States, Canada, Mexico, Costa Rica, Jamaica, Cuba",
    "Asia": (
        "China, Singapore, Japan, Hong Kong, South Korea, Taiwan, Macao, Saudi Arabia, United Arab Emirates, India, Qatar, Malaysia, "
        "Lebanon, Turkey, Iran, Brunei Darussalam, Jordan, Bahrain, Kazakhstan, Pakistan, Thailand, Uzbekistan, Vietnam, Kuwait, "
        "Bangladesh, Indonesia, Philippines, Sri Lanka, Fiji, Georgia, Armenia"
    ),
}
COUNTRY_REGION = {c: region for region, names in REGION_COUNTRIES.items() for c in names.split(", ")}

# The thesaurus, its categories in the order that decides ties.
THESAURUS = {
    "EXCELLENCE": "leading world top rank excellence best prestigous elite reputation award nobel founded history".split(),
    "INNOVATION": "innovation technology digital future modern new creative tech smart entrepreneur solution".split(),
    "SOCIETAL": "community social public sustainable environment health diversity inclusion global impact sdg".split(),
    "CAREER": "career job employability industry business skill professional work alumni salary".split(),
    "RESEARCH": "research study science knowledge academic theory publication institute phd faculty professor".split(),
}

# The eight groups of search terms.
TERM_GROUPS = {
    "artificial intelligence": "intelligence artificial".split(),
    "politics": "prime minister".split(),
    "engineering": "computer electrical civil mechanical chemical engineering".split(),
    "health": "dentistry nursing pharmacy".split(),
    "social media": "facebook youtube instagram".split(),
    "finance": "finance accounting".split(),
    "environment": "environmental sustainability".split(),
    "qualified": "highly qualified".split(),
}

# The words of the timeline, and how many documents of each snapshot it reads.
TIMELINE_WORDS = "founded science teach sustainable impact global collaboration innovation cultural people".split()
TIMELINE_DOCS = 200
