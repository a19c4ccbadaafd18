"""Fixed values that the text operators need: names and lists, in their natural order."""

from __future__ import annotations

#: Countries that a title can name.
COUNTRIES = (
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda", "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan",
    "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan", "Bolivia", "Bosnia and Herzegovina",
    "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso", "Burundi", "Côte d'Ivoire", "Cabo Verde", "Cambodia", "Cameroon", "Canada",
    "Central African Republic", "Chad", "Chile", "China", "Colombia", "Comoros", "Congo", "Costa Rica", "Croatia", "Cuba", "Cyprus",
    "the Czech Republic", "Republic of the Congo", "Denmark", "Djibouti", "Dominica", "Dominican Republic", "Ecuador", "Egypt", "El Salvador",
    "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji", "Finland", "France", "Gabon", "Gambia", "Georgia", "Germany",
    "Ghana", "Greece", "Grenada", "Guatemala", "Guinea", "Guinea-Bissau", "Guyana", "Haiti", "Holy See", "Honduras", "Hungary", "Iceland", "India",
    "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Ivory Coast", "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati",
    "Kosovo", "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya", "Liechtenstein", "Lithuania", "Luxembourg",
    "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta", "Marshall Islands", "Mauritania", "Mauritius", "Mexico", "Micronesia",
    "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar (formerly Burma)", "Namibia", "Nauru", "Nepal",
    "the Netherlands", "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan", "Palau",
    "Palestine State", "Panama", "Papua New Guinea", "Paraguay", "Peru", "the Philippines", "Poland", "Portugal", "Qatar", "Romania", "Russia",
    "Rwanda", "Saint Kitts and Nevis", "Saint Lucia", "Saint Vincent and the Grenadines", "Samoa", "San Marino", "Sao Tome and Principe",
    "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden", "Switzerland", "Syria", "Tajikistan",
    "Tanzania", "Thailand", "Timor-Leste", "Togo", "Tonga", "Trinidad and Tobago", "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda",
    "Ukraine", "the United Arab Emirates", "the United Kingdom", "the United States", "Uruguay", "Uzbekistan", "Vanuatu", "Venezuela", "Vietnam",
    "Yemen", "Zambia", "Zimbabwe",
)

#: Continents, which count as countries, and their adjectives.
CONTINENTALS = {
    "Asia": "asian", "Africa": "african", "North America": "north american", "South America": "south american", "Antarctica": "antarctic",
    "Europe": "european", "Oceania": "oceanic",
}

#: Continents of countries.
CONTINENT_OF = {
    "Australia": "Oceania", "Bangladesh": "Asia", "Canada": "North America", "China": "Asia", "France": "Europe", "Germany": "Europe",
    "India": "Asia", "Italy": "Europe", "Japan": "Asia", "Mexico": "North America", "New Zealand": "Oceania", "North Korea": "Asia",
    "the Philippines": "Asia", "Romania": "Europe", "Russia": "Asia", "Spain": "Europe", "South Korea": "Asia", "Thailand": "Asia",
    "the United Kingdom": "Europe", "the United States": "North America", "the Netherlands": "Europe", "Portugal": "Europe",
    "Switzerland": "Europe", "Belgium": "Europe", "Poland": "Europe", "Pakistan": "Asia", "Austria": "Europe", "South Africa": "Africa",
    "Sweden": "Europe", "Hungary": "Europe", "Egypt": "Africa", "Niger": "Africa", "Nigeria": "Africa", "Turkey": "Asia", "Kazakhstan": "Asia",
    "the Czech Republic": "Europe", "Indonesia": "Asia", "Serbia": "Europe", "Croatia": "Europe", "Bulgaria": "Europe",
    "the United Arab Emirates": "Asia", "Vietnam": "Asia", "Malaysia": "Asia", "Slovenia": "Europe", "Brunei": "Asia", "Syria": "Asia",
    "Estonia": "Europe", "Malta": "Europe", "Mongolia": "Asia", "Iraq": "Asia", "Kenya": "Africa", "Montenegro": "Europe",
    "Chile": "South America", "Guyana": "South America", "Burundi": "Africa", "Chad": "Africa", "Mozambique": "Africa", "South Sudan": "Africa",
    "Moldova": "Europe", "Botswana": "Africa", "Algeria": "Africa", "Togo": "Africa", "Tajikistan": "Asia", "Lebanon": "Asia",
    "Cameroon": "Africa", "Mauritius": "Africa", "Ghana": "Africa", "Denmark": "Europe", "Uruguay": "South America", "Nepal": "Asia",
    "Israel": "Asia", "Monaco": "Europe", "Senegal": "Africa", "Republic of the Congo": "Africa",
}

#: Nationalities of countries.
NATIONALITY_OF = {
    "Switzerland": "Swiss", "Australia": "Australian", "New Zealand": "New Zealand", "Russia": "Russian", "the United States": "American",
    "the United Kingdom": "British", "France": "French", "South Korea": "South Korean", "Mexico": "Mexican", "Japan": "Japanese",
    "Italy": "Italian", "Romania": "Romanian", "China": "Chinese", "Spain": "Spanish", "Germany": "German", "Canada": "Canadian",
    "India": "Indian", "the Netherlands": "Dutch", "Portugal": "Portuguese", "Belgium": "Belgian", "Pakistan": "Pakistani", "Thailand": "Thai",
    "Austria": "Austrian", "Poland": "Polish", "Sweden": "Swedish", "South Africa": "South African", "Hungary": "Hungarian",
    "Bangladesh": "Bangladeshi", "Egypt": "Egyptian", "the Czech Republic": "Czech", "the United Arab Emirates": "Emirati", "Niger": "Nigerien",
    "Nigeria": "Nigerian", "Croatia": "Croatian", "Indonesia": "Indonesian", "Serbia": "Serbian", "Slovenia": "Slovenian", "Estonia": "Estonian",
    "Bulgaria": "Bulgarian", "Turkey": "Turkish", "Guyana": "Guyana", "Monaco": "Monacan", "Mali": "Malian", "Lebanon": "Lebanese",
    "Bosnia and Herzegovina": "Bosnian", "Vietnam": "Vietnamese", "Denmark": "Danish", "Chile": "Chilean", "Azerbaijan": "Azerbaijani",
    "Mauritius": "Mauritian",
}

#: Names of infoboxes of persons.
PERSON_INFOBOXES = (
    "person", "football biography", "officeholder", "sportsperson", "writer", "scientist", "military person", "cricketer", "baseball biography",
    "artist", "basketball biography", "nfl biography", "ice hockey player", "christian leader", "rugby biography", "afl biography",
    "college coach", "academic", "tennis biography", "rugby league biography", "swimmer", "nfl player", "boxer", "saint", "golfer", "noble",
    "figure skater", "criminal", "professional wrestler", "diocese", "volleyball biography", "racing driver", "comics creator", "gymnast",
    "gaa player", "religious biography", "politician", "athlete", "badminton player", "philosopher", "chess player", "gridiron football person",
    "pageant titleholder", "curler", "nobility", "cfl biography", "skier", "model", "judge", "monarch", "speed skater", "college football player",
    "economist", "medical person", "serial killer", "gaelic athletic association player", "field hockey player", "sailor", "youtube personality",
    "playboy playmate", "nascar driver", "volleyball player", "motorcycle rider", "speedway rider", "chef", "bishopstyles",
    "horseracing personality", "clergy", "npb player", "darts player", "football official", "engineer", "squash player", "scholar",
    "table tennis player", "president", "president styles", "cfl player", "jewish leader", "governor", "mayor", "astronaut", "poker player",
    "snooker player", "indian politician", "presenter", "actor", "dancer", "mlb player", "fencer", "police officer", "netball biography",
    "fashion designer", "sumo wrestler", "nba biography", "prime minister", "ice hockey biography", "chess biography", "pharaoh", "ambassador",
    "lacrosse player", "hindu leader", "le mans driver", "musician", "latter day saint biography", "bishop styles", "water polo biography",
    "wrc driver", "minister", "canadianmp", "biathlete", "state representative", "cardinal styles", "bodybuilder", "aviator", "classical composer",
    "shogi professional", "ski jumper", "theologian", "spy", "bishop", "go player", "climber", "soldier", "murderer", "egyptian dignitary",
    "patriarch", "author", "champ car driver", "pro gaming player", "pool player", "surfer", "equestrian", "congressman", "sport wrestler",
    "motocross rider", "twitch streamer", "lds biography", "actress", "biography", "itf women", "comedian", "video game player",
    "basketball player", "triathlete", "rebbe", "journalist", "first lady", "archbishop", "state senator", "mass murderer", "bandy biography",
    "roman emperor", "sports announcer", "historian", "mountaineer",
)
