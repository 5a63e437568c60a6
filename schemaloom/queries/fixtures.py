"""Small models for the queries on metadata: our own flight bookings."""

from __future__ import annotations

_a = lambda name, kind="VARCHAR", pk=False, ref=None: {"name": name, "data_type": kind, "is_primary_key": pk, "is_foreign_key": bool(ref), "references": ref}
_r = lambda a, b, fk, pk=None, ca="0..N", cb="1": {"from_entity": a, "to_entity": b, "fk_attribute": fk, "pk_attribute": pk, "from_cardinality": ca, "to_cardinality": cb}

#: A reference model: natural keys, a composite foreign key, two roles of one target, a relator and a pure junction.
ERD_TRUTH = {
    "entities": [
        {"name": "Airport", "primary_key": ["airport_code"], "attributes": [_a("airport_code", pk=True), _a("city")]},
        {"name": "Flight", "primary_key": ["flight_number", "flight_date"], "attributes": [_a("flight_number", pk=True), _a("flight_date", "DATE", True), _a("origin_code", ref="Airport.airport_code"), _a("target_code", ref="Airport.airport_code")]},
        {"name": "Passenger", "primary_key": ["passport"], "attributes": [_a("passport", pk=True), _a("full_name")]},
        {"name": "Booking", "primary_key": ["flight_number", "flight_date", "passport"], "attributes": [_a("flight_number", pk=True, ref="Flight.flight_number"), _a("flight_date", "DATE", True, "Flight.flight_date"), _a("passport", pk=True, ref="Passenger.passport"), _a("seat")]},
        {"name": "visits", "primary_key": ["passport", "airport_code"], "attributes": [_a("passport", pk=True, ref="Passenger.passport"), _a("airport_code", pk=True, ref="Airport.airport_code")]},
    ],
    "relationships": [_r("Airport", "Flight", "origin_code"), _r("Airport", "Flight", "target_code"), _r("Passenger", "Booking", "passport"), _r("Flight", "Booking", "flight_number")],
}
#: What the data of one flat table would give.
ERD_BASE = {
    "entities": [
        {"name": "Bookings", "primary_key": ["seat"], "attributes": [_a("seat", "string", True), _a("passport", "string"), _a("flight_number", "string"), _a("flight_date", "datetime"), _a("origin_code", "string", ref="Airport.airport_code")]},
        {"name": "Airport", "primary_key": ["airport_code"], "attributes": [_a("airport_code", "string", True), _a("city", "string")]},
    ],
    "relationships": [_r("Bookings", "Airport", "origin_code", "airport_code")],
}
#: A proposal that leaves columns out.
ERD_PROPOSAL = {
    "entities": [
        {"name": "Booking", "primary_key": ["seat"], "attributes": [_a("seat", "INT", True), _a("passport", "INT"), _a("mood", "TEXT")]},
        {"name": "Airport", "primary_key": ["airport_code"], "attributes": [_a("airport_code", "INT", True)]},
        {"name": "Airport", "primary_key": ["iata"], "attributes": [_a("iata", "TEXT", True)]},
    ],
    "relationships": [_r("Booking", "Airport", "mood")],
}
#: A model with every kind of wrong relationship.
ERD_A = {
    "entities": [{"name": "Order", "primary_key": ["id"], "attributes": [_a("id", pk=True), _a("Customer_ID")]}, {"name": "Customer", "primary_key": ["customer_id"], "attributes": [_a("customer_id", pk=True), _a("region")]}],
    "relationships": [
        _r("Order", "Customer", "customer_id", "customer_id"), _r("Customer", "Order", "customer_id", "customer_id", "1", "0..N"), _r("Order", "Shop", "shop", "id"), _r("Order", "Customer", "region", "customer_id"),
        _r("Order", "Customer", "customer_id", "customer_id", "0..N", "1..N"), _r("Order", "Customer", None, None, "many", "1"), _r("Order", "Customer", "customer_id", "id", "1", "1"),
    ],
}

#: Ontologies: (concept, category, source) and (concept, source, mapping type, name, target, accepted names).
_p = lambda c, s, n: (c, s, "property", n, None, [])
_o = lambda c, s, n, t, also=(): (c, s, "relation_role", n, t, list(also))
ONTOLOGY_A = (
    [("Flight", "kind", "Flight"), ("Passenger", "kind", "Passenger"), ("Airplane", "kind", "Airplane"), ("Seat Assignment", "relator", "Booking"), ("Gate", "category", "Gate")],
    [_p("Flight", "Flight.no", "flightNumber"), _p("Flight", "Flight.day", "date"), _o("Flight", "Flight.plane", "operatedWith", "Airplane"), _p("Passenger", "Passenger.name", "full name"), _p("Airplane", "Airplane.reg", "registration"), _o("Seat Assignment", "Booking.p", "hasPassenger", "Passenger"), _o("Seat Assignment", "Booking.f", "hasFlight", "Flight")],
)
ONTOLOGY_B = (
    [("Flight", "kind", "flights"), ("Traveller", "kind", "people"), ("Aircraft", "kind", "aircraft"), ("Booking", "relator", "bookings"), ("Fare", "category", "fares")],
    [_p("Flight", "flights.no", "flight_number"), _p("Flight", "flights.dep", "departure"), _o("Flight", "flights.reg", "uses", "Aircraft"), _p("Traveller", "people.name", "fullName"), _p("Aircraft", "aircraft.reg", "registration"), _o("Booking", "bookings.pax", "hasPassenger", "Traveller"), _o("Booking", "bookings.flight", "hasFlight", "Flight"), _p("Fare", "fares.class", "class")],
)
#: An expert's mapping of the reference model.
GOLD_CONCEPTS = (
    [("Airport", "kind", "Airport"), ("Scheduled Flight", "kind", "Flight"), ("Passenger", "kind", "Passenger"), ("Reservation", "relator", "Booking")],
    [
        _p("Airport", "Airport.airport_code", "airportCode"), _p("Airport", "Airport.city", "cityName"), _p("Scheduled Flight", "Flight.flight_number", "flightNumber"), _p("Scheduled Flight", "Flight.flight_date", "departureDate"),
        _o("Scheduled Flight", "Flight.origin_code", "departsFrom", "Airport", ["origin code"]), _o("Scheduled Flight", "Flight.target_code", "arrivesAt", "Airport"), _p("Passenger", "Passenger.passport", "passport"), _p("Passenger", "Passenger.full_name", "name"),
        _o("Reservation", "Booking.flight_number", "flight", "Flight"), _o("Reservation", "Booking.passport", "hasPassenger", "Passenger"), _p("Reservation", "Booking.seat", "seat"),
    ],
)
#: A proposal with words around its JSON, a wrong category, a wrong source and gaps.
PROPOSAL = """Sure! {"concepts": [
 {"canonical_name": "Airport", "ontological_category": "thing", "source_entity": "Airport", "attributes": [
  {"source": "Airport.airport_code", "maps_to": {"type": "property", "canonical_name": "code", "role": "identifier"}},
  {"source": "city", "maps_to": {"type": "property", "canonical_name": "city", "role": "descriptive"}}]},
 {"canonical_name": "Flight", "ontological_category": "kind", "source_entity": "Flight", "attributes": [
  {"source": "Flight.origin_code", "maps_to": {"type": "relation_role", "relation": "departsFrom"}}]}],
 "relations": []} Hope this helps."""
