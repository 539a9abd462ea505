"""The catalogue of issue types: a static dimension of 63 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The id, default severity and default category of every issue type.
TYPES = """
missing_title critical content
title_too_long warning content
title_too_short info content
missing_meta_description warning content
meta_description_too_long info content
meta_description_too_short info content
missing_h1 critical structure
multiple_h1 warning structure
missing_h2 info structure
heading_non_sequential warning structure
noindex critical technical
important_page_noindex critical technical
non_200_status warning technical
slow_response warning performance
missing_canonical warning technical
non_self_referencing_canonical info technical
no_canonical_tag warning technical
external_canonical critical technical
canonicalized_url info technical
duplicate_title warning content
duplicate_meta_description warning content
duplicate_content warning content
thin_content warning content
keyword_cannibalization warning content
redirect_chain warning technical
canonical_cluster info technical
hreflang_duplicate_lang warning internationalization
hreflang_invalid_code warning internationalization
hreflang_missing_reciprocal warning internationalization
hreflang_invalid_target warning internationalization
image_missing_alt_attribute warning content
images_without_alt warning content
image_oversized warning performance
image_missing_dimensions info performance
image_missing_lazy_loading info performance
missing_structured_data warning technical
structured_data_missing_fields warning technical
product_missing_price warning technical
article_missing_author warning technical
breadcrumb_invalid warning technical
amp_missing_canonical warning technical
amp_invalid_target warning technical
amp_canonical_mismatch warning technical
missing_security_header warning security
missing_hsts warning security
missing_csp warning security
missing_x_content_type_options warning security
missing_x_frame_options warning security
missing_referrer_policy warning security
mixed_content critical security
insecure_http critical security
missing_og_tags info social
og_missing_image info social
missing_twitter_card info social
twitter_missing_image info social
orphaned_page warning links
anchor_text_over_optimized info links
internal_link_to_4xx critical links
broken_pagination_chain warning technical
missing_pagination_canonical warning technical
sitemap_url_not_crawled warning technical
crawled_url_missing_from_sitemap warning technical
sitemap_url_error_status warning technical
"""
DEFAULTS = {i: (severity, category) for i, severity, category in (line.split() for line in TYPES.split("\n") if line)}

#: What each type means | what to do about it.
TEXTS = """
missing_title: The page has no title element, or an empty one, so result lists and browser tabs have nothing to show for it. | Write a title of 30 to 60 characters that says what this page alone is about.
title_too_long: The title has more than 60 characters; result lists cut it before its end. | Put what matters first and bring the title down to 60 characters.
title_too_short: The title has fewer than 30 characters and leaves most of its room unused. | Add the subject, the place or the name that tells this page from its neighbours.
missing_meta_description: No description is given, so engines pick a passage of the page as they like. | Describe the page's use to a reader in 70 to 160 characters.
meta_description_too_long: The description has more than 160 characters and is cut in result lists. | Keep the offer in the first 160 characters and drop the rest.
meta_description_too_short: The description has fewer than 70 characters, too few to tell pages apart. | Say in one more sentence what the reader finds here.
missing_h1: There is no main heading, so neither readers nor engines learn the subject at a glance. | Give the page one h1 that names its subject.
multiple_h1: The page has more than one main heading, which blurs what it is about. | Keep the h1 that names the page and turn the others into h2.
missing_h2: A page with text has no second-level heading, so its parts can't be told apart. | Break the text into parts and head each with an h2.
heading_non_sequential: A heading level is skipped on the way down, which breaks the outline that screen readers use. | Use the next level down wherever a part goes deeper.
noindex: The robots tag asks engines to leave the page out of their index. | Take the tag off if the page is meant to be found; else leave links to it out of menus.
important_page_noindex: A page that answers normally is closed to the index by its robots tag. | Check whether that is meant, and take off noindex or none if it isn't.
non_200_status: The address answers with an error, so neither readers nor engines get the page. | Repair the page, redirect the address to its successor, or correct the links to it.
slow_response: The server took more than three seconds to answer. | Find the slow query or service behind the page, or keep its answer in a cache.
missing_canonical: The page doesn't say which address is its own, so variants of it compete. | Add a canonical link with the address that should be found.
non_self_referencing_canonical: The canonical link names another address than the page's, so this one asks not to be listed. | Confirm that the other page is the main one, or point the link at this page.
no_canonical_tag: After the crawl the page still had no canonical link. | Add one to the page's template; it may name the page itself.
external_canonical: The canonical link leads to another host, which gives the page's standing away. | Point it at this site, unless the other site really owns the text.
canonicalized_url: The page names another address of this site as the main one. | Link to that address directly and leave this one out of the sitemap.
duplicate_title: Several pages share this title. | Give each page a title with what only it has.
duplicate_meta_description: Several pages share this description. | Write one for each, or leave it out where nothing special can be said.
duplicate_content: The texts of several pages are equal. | Keep one, redirect the others or name it as their canonical.
thin_content: The page has fewer than 300 words. | Answer more of what readers ask about the subject, or merge the page into a fuller one.
keyword_cannibalization: Several pages make most use of the same word, and so compete for it. | Choose the page that should be found for it and give the others their own subject.
redirect_chain: The address was reached over one or more redirects, each of which costs time. | Link to the last address, and let old ones lead there in one step.
canonical_cluster: More than two pages name the same canonical address. | Check that they are variants of it, and drop those that nobody needs.
hreflang_duplicate_lang: A language is named more than once among the page's alternates. | Keep one alternate for each language and region.
hreflang_invalid_code: A language code isn't of the form xx, xx-YY or x-default. | Use ISO 639-1 for the language and ISO 3166-1 for the region.
hreflang_missing_reciprocal: The page names an alternate that doesn't name it in turn, so engines ignore the pair. | Add the link back on the other page.
hreflang_invalid_target: An alternate is no web address, or answers with an error. | Correct its address or take the alternate out.
image_missing_alt_attribute: Images have no alternative text, so they say nothing to those who can't see them. | Describe what each shows; leave it empty only where it decorates.
images_without_alt: More than a fifth of the page's images have no alternative text. | Describe them, those that carry meaning first.
image_oversized: The page's images weigh more than 1024 KB together. | Compress them, serve the size that is shown, and use a modern format.
image_missing_dimensions: Images come without width and height, so the page jumps while they load. | State both, in the markup or by an aspect ratio.
image_missing_lazy_loading: Images further down load at once, though nobody sees them yet. | Set loading=lazy on all but the first ones.
missing_structured_data: The page has no data that machines can read. | Describe its subject by a type that fits, as JSON-LD.
structured_data_missing_fields: A block of structured data lacks fields that its type requires. | Add the fields that are named, or use a type that does without them.
product_missing_price: A product has no offer, so its price can't be shown in results. | Add offers with price, currency and availability.
article_missing_author: An article doesn't name its author. | Add the author as a person or an organisation.
breadcrumb_invalid: A breadcrumb list has no elements. | List its steps as itemListElement, with place, name and address.
amp_missing_canonical: An AMP page doesn't name the page that it stands for. | Add a canonical link to the ordinary page.
amp_invalid_target: The AMP address is no web address, is the page itself, or leads to a page that isn't AMP. | Point the link at the AMP version, or take it out.
amp_canonical_mismatch: The AMP page names another page than the one that leads to it. | Let the two name each other.
missing_security_header: A header that protects visitors isn't set. | Set it for all pages in the server's configuration.
missing_hsts: The answer doesn't tell browsers to use https from now on. | Send Strict-Transport-Security with a long max-age.
missing_csp: No policy says which sources scripts and frames may come from. | Start with a Content-Security-Policy that reports, then enforce it.
missing_x_content_type_options: Browsers may guess the type of files and run what they shouldn't. | Send X-Content-Type-Options: nosniff.
missing_x_frame_options: Other sites may show the page inside a frame and lead clicks astray. | Send X-Frame-Options, or frame-ancestors in the content policy.
missing_referrer_policy: Addresses of visited pages may leak to other sites. | Send Referrer-Policy: strict-origin-when-cross-origin or stricter.
mixed_content: A page served over https loads parts over http, which browsers block or warn of. | Load every part over https.
insecure_http: The page is served over plain http, so it can be read and changed on its way. | Serve it over https and redirect the old address.
missing_og_tags: The page has no Open Graph title, description or image, so shared links look bare. | Add og:title, og:description and og:image.
og_missing_image: The Open Graph tags name no image. | Add og:image with an address that anyone may load.
missing_twitter_card: No card type is given for links shared there. | Add twitter:card, summary or summary_large_image.
twitter_missing_image: The card that goes with shared links names no image. | Add twitter:image, or an og:image that it may fall back on.
orphaned_page: No page of the site links to this one, so it is found by the sitemap alone or not at all. | Link to it where its subject comes up.
anchor_text_over_optimized: Most links to the page say the same words, which looks arranged. | Let links say what their own sentence needs.
internal_link_to_4xx: The page links to pages of this site that don't exist. | Correct the links or take them out.
broken_pagination_chain: The next or previous page that is named wasn't found. | Let the first page have no previous and the last no next one, and the others name pages that exist.
missing_pagination_canonical: A page of a series has no canonical link. | Let each page of the series name itself.
sitemap_url_not_crawled: The sitemap lists an address that the crawl didn't reach. | Link to it, or take it out of the sitemap.
crawled_url_missing_from_sitemap: A page that may be indexed isn't in the sitemap. | Add it, or close it to the index if it shouldn't be found.
sitemap_url_error_status: The sitemap lists an address that answers with an error. | Take it out or repair the page.
"""
TOLD = {i: tuple(x.strip() for x in text.split(" | ")) for i, text in (line.split(": ", 1) for line in TEXTS.split("\n") if line)}

#: Advice for types that the catalogue doesn't know, by category.
GENERAL = {
    "content": "Revise the page's content.", "structure": "Put the page's headings in order.", "technical": "Correct the page's technical tags.", "performance": "Make the page lighter or faster.",
    "security": "Set the response header or protocol that protects visitors.", "social": "Add the tags that social networks read.", "links": "Revise the links to the page.", "internationalization": "Correct the language links.",
}
SCHEMA = "issue_type string, label string, severity string, category string, explanation string, recommendation string"


def definition(issue_type: str) -> tuple[str, str, str, str, str, str]:
    """A row for any id; an unknown one gets a label made from its id, and is a technical warning."""
    severity, category = DEFAULTS.get(issue_type, ("warning", "technical"))
    label = issue_type.replace("_", " ").capitalize()
    explanation, advice = TOLD.get(issue_type, (f"{label} was found on the page.", GENERAL[category]))
    return issue_type, label, severity, category, explanation, advice


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([definition(i) for i in DEFAULTS], SCHEMA)
