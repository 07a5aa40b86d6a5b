"""Letters with personal data, made from the customer table by SQL that Spark and DuckDB share."""

from __future__ import annotations

#: Valid and invalid tax numbers, cards and accounts come in turn with the key.
LETTERS = """
SELECT k AS letter_id,
  'Sehr geehrte Frau Dr. ' || last || ',' || chr(10) || 'Meyer, ' || first || ' schreibt am ' || day || '.' || month || '.20' || year || ' aus ' || city || '.' || chr(10)
  || 'Konto: ' || iban || '.' || chr(10) || 'BIC: COBADEFF' || bic || ', USt-IdNr. DE' || vat || '.' || chr(10)
  || 'Telefon: 04451 / 15 ' || phone || ';' || chr(10) || 'Steuer-ID: ' || tax || '.' || chr(10) || 'Kennung ' || tax || ' ohne Angabe, davor viele weitere Worte im Text.' || chr(10)
  || 'Karte: ' || card || '.' || chr(10) || 'Anschrift: Hauptstrasse, Lindenweg ' || house || ', ' || code || ' ' || city || '.' || chr(10)
  || 'Firma Nordwind Handel GmbH, Internet: https://www.firma' || k || '.example.com/kontakt?id=' || k || '. Post: ' || lower(first) || k || '@example.com, Hash 0x49301234567a.' || chr(10)
  || 'Herr ' || first || ' ' || last || ' und ' || first || ' gruessen.' || chr(10) AS text
FROM (
  SELECT c_custkey AS k,
    CASE c_custkey % 5 WHEN 0 THEN 'Petra' WHEN 1 THEN 'Stefan' WHEN 2 THEN 'Anna' WHEN 3 THEN 'Uwe' ELSE 'Marion' END AS first,
    CASE c_custkey % 4 WHEN 0 THEN 'Schmidt' WHEN 1 THEN 'Weber' WHEN 2 THEN 'Becker' ELSE 'Wolf' END AS last,
    CASE c_custkey % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Hamburg' WHEN 2 THEN 'Bremen' ELSE 'Oldenburg' END AS city,
    lpad('' || (c_custkey % 28 + 1), 2, '0') AS day, lpad('' || (c_custkey % 12 + 1), 2, '0') AS month, lpad('' || (c_custkey % 25), 2, '0') AS year,
    'DE' || lpad('' || (98 - (((37040044 % 97) * 49 + c_custkey) % 97 * 27 + 62 + c_custkey % 3) % 97), 2, '0') || '37040044' || lpad('' || c_custkey, 10, '0') AS iban,
    CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'XXX' END AS bic, lpad('' || (100000000 + c_custkey), 9, '0') AS vat, lpad('' || (c_custkey % 1000), 3, '0') AS phone,
    CASE c_custkey % 3 WHEN 0 THEN '86095742719' WHEN 1 THEN '86095742718' ELSE '06095742719' END AS tax,
    CASE c_custkey % 2 WHEN 0 THEN '4532015112830366' ELSE '4532 0151 1283 036' || (c_custkey % 10) END AS card,
    '' || (c_custkey % 90 + 1) AS house, lpad('' || (10000 + c_custkey % 80000), 5, '0') AS code
  FROM customer
)
"""
