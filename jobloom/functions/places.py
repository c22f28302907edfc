"""Places by name."""

from __future__ import annotations

# Written forms of cities.
CITIES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "blr": "Bengaluru", "bombay": "Mumbai", "mumbai": "Mumbai", "madras": "Chennai",
    "chennai": "Chennai", "calcutta": "Kolkata", "kolkata": "Kolkata", "gurgaon": "Gurugram", "gurugram": "Gurugram", "new delhi": "Delhi",
    "delhi": "Delhi", "ncr": "Delhi", "hyderabad": "Hyderabad", "pune": "Pune", "noida": "Noida", "ahmedabad": "Ahmedabad", "kochi": "Kochi",
    "cochin": "Kochi", "coimbatore": "Coimbatore", "jaipur": "Jaipur", "trivandrum": "Thiruvananthapuram", "sf": "San Francisco",
    "san francisco": "San Francisco", "nyc": "New York", "new york": "New York", "new york city": "New York", "sea": "Seattle", "seattle": "Seattle",
    "austin": "Austin", "london": "London", "berlin": "Berlin", "amsterdam": "Amsterdam", "singapore": "Singapore", "dublin": "Dublin",
    "toronto": "Toronto", "san francisco bay area": "San Francisco", "bay area": "San Francisco", "chicago": "Chicago", "menlo park": "Menlo Park",
    "foster city": "Foster City", "mountain view": "Mountain View", "palo alto": "Palo Alto", "santa clara": "Santa Clara", "nashville": "Nashville",
    "mexico city": "Mexico City", "tokyo": "Tokyo", "barcelona": "Barcelona", "são paulo": "São Paulo", "sao paulo": "São Paulo", "paris": "Paris",
    "munich": "Munich", "münchen": "Munich", "madrid": "Madrid", "sydney": "Sydney", "warsaw": "Warsaw",
}

# Countries of cities.
CITY_COUNTRY = {
    "Bengaluru": "IN", "Mumbai": "IN", "Chennai": "IN", "Kolkata": "IN", "Gurugram": "IN", "Delhi": "IN", "Hyderabad": "IN", "Pune": "IN",
    "Noida": "IN", "Ahmedabad": "IN", "Kochi": "IN", "Coimbatore": "IN", "Jaipur": "IN", "Thiruvananthapuram": "IN", "San Francisco": "US",
    "New York": "US", "Seattle": "US", "Austin": "US", "London": "GB", "Berlin": "DE", "Amsterdam": "NL", "Singapore": "SG", "Dublin": "IE",
    "Toronto": "CA", "Chicago": "US", "Menlo Park": "US", "Foster City": "US", "Mountain View": "US", "Palo Alto": "US", "Santa Clara": "US",
    "Nashville": "US", "Mexico City": "MX", "Tokyo": "JP", "Barcelona": "ES", "São Paulo": "BR",
}

# Cities that resolve only without a region.
NAMESAKES = {
    "Paris": "FR", "Munich": "DE", "Madrid": "ES", "Sydney": "AU", "Warsaw": "PL",
}

# States and provinces.
STATES = {
    "alabama": "US", "alaska": "US", "arizona": "US", "arkansas": "US", "california": "US", "colorado": "US", "connecticut": "US", "delaware": "US",
    "florida": "US", "hawaii": "US", "idaho": "US", "illinois": "US", "indiana": "US", "iowa": "US", "kansas": "US", "kentucky": "US",
    "louisiana": "US", "maine": "US", "maryland": "US", "massachusetts": "US", "michigan": "US", "minnesota": "US", "mississippi": "US",
    "missouri": "US", "montana": "US", "nebraska": "US", "nevada": "US", "new hampshire": "US", "new jersey": "US", "new mexico": "US",
    "north carolina": "US", "north dakota": "US", "ohio": "US", "oklahoma": "US", "oregon": "US", "pennsylvania": "US", "rhode island": "US",
    "south carolina": "US", "south dakota": "US", "tennessee": "US", "texas": "US", "utah": "US", "vermont": "US", "virginia": "US",
    "washington": "US", "west virginia": "US", "wisconsin": "US", "wyoming": "US", "ontario": "CA", "quebec": "CA", "british columbia": "CA",
    "alberta": "CA", "manitoba": "CA", "nova scotia": "CA", "saskatchewan": "CA",
}

# Written forms of countries.
COUNTRIES = {
    "india": "IN", "united states": "US", "usa": "US", "us": "US", "u.s.": "US", "america": "US", "united kingdom": "GB", "uk": "GB", "england": "GB",
    "britain": "GB", "germany": "DE", "netherlands": "NL", "singapore": "SG", "ireland": "IE", "canada": "CA", "australia": "AU", "china": "CN",
    "japan": "JP", "hungary": "HU", "portugal": "PT", "vietnam": "VN", "viet nam": "VN", "thailand": "TH", "france": "FR", "spain": "ES",
    "poland": "PL", "brazil": "BR", "malaysia": "MY", "turkey": "TR", "türkiye": "TR", "estonia": "EE", "philippines": "PH", "bulgaria": "BG",
    "serbia": "RS", "slovenia": "SI", "finland": "FI", "israel": "IL", "colombia": "CO", "mexico": "MX", "belgium": "BE", "italy": "IT",
    "switzerland": "CH", "austria": "AT", "sweden": "SE", "denmark": "DK", "norway": "NO", "czechia": "CZ", "czech republic": "CZ", "romania": "RO",
    "greece": "GR", "south africa": "ZA", "new zealand": "NZ", "united arab emirates": "AE", "uae": "AE", "indonesia": "ID", "south korea": "KR",
    "korea": "KR", "taiwan": "TW", "hong kong": "HK",
}

# Region codes that are no country codes.
REGIONS = {
    "AB": "CA", "BC": "CA", "MB": "CA", "NB": "CA", "NS": "CA", "NT": "CA", "NU": "CA", "QC": "CA", "SK": "CA", "YT": "CA", "AK": "US", "CT": "US",
    "DC": "US", "FL": "US", "HI": "US", "IA": "US", "IL": "US", "KS": "US", "MA": "US", "MI": "US", "ND": "US", "NH": "US", "NJ": "US", "NM": "US",
    "NV": "US", "NY": "US", "OH": "US", "OK": "US", "OR": "US", "RI": "US", "TX": "US", "UT": "US", "VT": "US", "WA": "US", "WI": "US", "WV": "US",
    "WY": "US",
}

# Regions of cities.
CITY_REGION = {
    "Bengaluru": "KA", "Mumbai": "MH", "Pune": "MH", "Hyderabad": "TG", "Chennai": "TN", "Coimbatore": "TN", "Kolkata": "WB", "Delhi": "DL",
    "Gurugram": "HR", "Noida": "UP", "Ahmedabad": "GJ", "Jaipur": "RJ", "Kochi": "KL", "Thiruvananthapuram": "KL",
}
