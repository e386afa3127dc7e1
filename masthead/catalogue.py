"""The guideline catalogue, as plain data.  Everything here is a fixed value."""

# --- fixed values: (reference, category or None, title, description, examples) ---
GUIDELINES = [
    ["Guideline 1", "Distinctiveness & Root Words", "Generic or Root Word Titles Prohibited", "The proposed titles should preferably contain more than one word formed by combining distinct and meaningful terms. Generic, or root word titles shall not be registered. Generic or Root words are those words which cannot be broken down further.", ["Manthan", "Darpan", "Inspire", "Success", "Khulasa", "Rahasya", "Katha", "Herald", "Malar", "Mukhi", "Nukkad"]],
    ["Guideline 2", "Phonetic & Visual Uniqueness", "Phonetic and Visual Deceptive Similarity", "The proposed titles must be unique and shall not be phonetically or visually similar to any existing registered title whether in the same language across India or any other language within the same State.", ["Namascar vs Namaskar", "Daineq vs Dainik", "Same state cross-language resemblance"]],
    ["Guideline 3", "Public Decency & Morality", "Negative Connotations, Obscene & Crime Terms", "Titles should be meaningful and clear. Titles with negative connotations with religious sentiments, obscene, absurd or offensive to public sentiments or those that could be misused with words like 'crime', 'corruption' etc. will not be registered.", ["Crime", "Corruption", "Scam", "Extortion", "Vulgar / Obscene words", "Offensive religious terms"]],
    ["Guideline 4", "Acronyms & Numerals", "Abbreviations, Acronyms and Numerals Requirement", "Abbreviations, acronyms or numerals will be considered only if they are meaningfully and appropriately attached with other words. Standalone or arbitrary abbreviations/numbers are not permitted.", ["999", "XYZ", "24x7 standalone", "Meaningful combination required (e.g. 'Mission 2047 Express')"]],
    ["Guideline 5", "Combination Titles", "Combination or Rearrangement of Registered Titles", "Titles that combine existing registered titles whether in full, in part or by rearranging words or inserting non-distinctive terms that do not create a significantly different title will not be registered.", ["Hindu Indian Express", "Dainik Jagran Kesari", "Times of India Herald"]],
    ["Guideline 6", "Personal Names", "Individual Names of Owner or Publisher Prohibited", "Titles denoting the name of an individual should not be the names of the owner or publisher of the proposed periodical to avoid misleading personal attribution.", ["Rajan Times (if owner is Rajan)", "Deepak Samachar (if owner is Deepak)", "Jitendra News"]],
    ["Guideline 7", "Special Characters", "Signs, Symbols, Emojis and Non-Text Characters", "Titles containing non-text characters, or any form of signs, symbols including mathematical symbols (like '+', '*', etc.), pictographs, photographs, hallmarks, logos, monograms, phonograms, emojis, etc. will not be registered.", ["News+Times", "Bharat*Post", "24/7 Daily", "Emojis & pictographs", "Logos / Monograms"]],
    ["Guideline 8", "Generic Modifiers", "Insignificant Prefixes, Suffixes & Generic Modifiers", "Titles formed by insignificantly prefixing or suffixing generic or repetitive terms to an existing title—such as addition names of cities or states, periodicity or language, or addition of articles (A, An, The) prepositions or adjectives to an already existing title—will not be approved.", ["The Times", "Daily Dainik News", "Saptahik Weekly", "Sandhya Evening", "Mumbai Express (if Express registered)"]],
    ["Guideline 9", "Legal & Judicial", "Judicial Pronouncements, Copyright, Trademark & Defamation", "The proposed title shall not be registered if it is found to be in violation of any judicial pronouncement including matters involving copyright, trademark infringement, contempt of court and defamation.", ["Trademarked Brand Clones", "Judicially Restrained Names", "Contemptuous Titles", "Defamatory Labels"]],
    ["Guideline 10", "National Security", "Sovereignty, Integrity of India & Public Order", "Titles containing words which can be construed as affecting the sovereignty and integrity of India, Security of the State, International Relations, Public order, Morality and public decency, incite unrest or disorder etc. will not be registered.", ["Secessionist Terms", "Insurrection / Riot Incitement", "Hostile International Terms", "Public Disorder"]],
    ["Guideline 11", "Emblems Act Compliance", "National Symbols, Emblems & Emblems Act 1950", "Titles similar to any national symbol, national motto, or suggesting misleading association with Central Government/State Governments/Local bodies/Constitutional bodies/Statutory bodies or are violative of 'The Emblems and Names (Prevention of Improper Use) Act, 1950' or any other law in force will not be registered.", ["Ashoka Chakra", "National Emblem", "Bharat Ratna", "President", "Satyameva Jayate", "United Nations"]],
    ["Guideline 12", "Official Authority Blacklist", "Government Organs, Regulatory Agencies & Public Schemes", "Titles containing names of Government Organizations/ Departments, Regulatory/Enforcement Agencies (such as 'Police', 'Bureau', 'Investigation Department', 'Vigilance', 'CID', 'CBI', Commission, Defence Establishment, etc.), Foreign Governments, International Organizations (e.g., UN, WHO, ILO) in any language, or words like Sarkar, Government, Parliament etc. or title containing the names of public welfare schemes of Central/State Governments or its organizations or local bodies which suggest a misleading association with them shall not be registered.", ["Police", "Crime Bureau", "CID", "CBI", "Army", "Vigilance", "Sarkar", "Government", "Parliament", "Public Schemes"]],
    ["Guideline 13", "Foreign Association", "Misleading Foreign Country or City Association", "Titles suggesting any association with a foreign country, city, or place which does not correspond to the State or place of publication of the periodical shall not be registered.", ["South Africa Times", "Canada Times", "New York Mirror", "London Chronicle (published in India)"]],
    ["Guideline 14", "National Dignitaries", "Names of Prominent National Leaders & Heads of Government", "Titles with the names of national leaders or those resembling the names of prominent national leaders, Heads of Government, and functionaries of Central and State governments will not be registered. However, names of recognized national and state political parties will be considered if applied by the concerned organization.", ["Mahatma Gandhi Times", "Prime Minister Gazette", "Chief Minister Post", "Governor Herald"]],
    ["Guideline 15", "Broadcast Media", "Satellite TV Channels, FM Radio & Broadcast Names (MIB)", "Title registered as a Satellite TV Channel/FM Radio/Community Radio Station with the Ministry of Information and Broadcasting shall not be registered unless the application is made by their owner or by their representative on his behalf.", ["News Nation", "News Time", "Aajtak News", "Akaashvani Times", "Dabang News"]],
    ["Guideline 16", "Well-Known Periodicals", "Protection of Well-Known Periodicals", "Titles resembling the titles of well-known periodicals if applied by anyone other than the existing owner of the well-known title shall not be registered. This is to avoid any false/misleading impression of association with the well-known periodical.", ["India Today Lookalikes", "Time Magazine Clones", "Reader's Digest Imitations", "Famous Journal Clones"]],
    ["Guideline 17", "Commercial & Non-Periodical", "Advertisements, Classifieds, Tenders & Directories", "Titles using words like Ad or Advertisement, Classifieds, Tender, Calendar, Panchang, Matrimonial, Yellow pages (generally prefixed with white, pink, etc.), pamphlet, brochure, directory, or any such publication which cannot be treated as a periodical shall not be registered.", ["Ad Express", "Classifieds Weekly", "Tender Gazette", "Panchang Patrika", "Yellow Pages Directory", "Matrimonial News"]],
    ["Guideline 18", "Ownership & Editions", "Transfer of Ownership & New Edition Restrictions", "Registration of new editions and transfer of ownership of an existing periodical with a title falling in the categories specified under points 3 and 9 to 13 of these guidelines will not be considered.", ["Edition expansion blocked for restricted words", "Transfer barred for non-compliant legacy titles", "Strict adherence to Guidelines 3 & 9–13"]],
    ["PRGI General Rule", None, "Non-Text Characters, Symbols & Emojis Prohibition", "Titles containing non-text characters, signs, symbols including mathematical symbols ('+', '*', etc.), pictographs, hallmarks, logos, monograms, phonograms, emojis, etc. are strictly prohibited.", ["News+", "Daily*Express", "Star #1", "News 📰", "Daily@Morning"]],
    ["PRGI General Rule", None, "Numeric-Only Title Prohibition", "Titles consisting solely of numbers or digits without substantive alphabetical/text characters are not permitted.", ["12345", "2024", "24 7", "99 100"]],
]
