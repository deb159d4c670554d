"""Fixed values that results must carry verbatim.

These strings are part of the output contract (state names, history notes,
status labels and reject messages), so they are kept here together, in
their natural order, as plain text.
"""

# Car states (id, name).
CAR_STATES = [(1, "waiting"), (2, "rented"), (3, "onserving")]
WAITING, RENTED, ONSERVING = 1, 2, 3

# Order status codes in the history table.
STATUS_OPEN = "0"
STATUS_CLOSED = "1"

# Status labels of the history export and of orders_changes.
EXPORT_STATUS = {"1": "returned", "0": "rented"}
CHANGE_STATUS = {"1": "closed", "0": "open"}

# History notes.
NOTE_CLIENT_CHANGED = "client was changed."
NOTE_RENEWED = "client renewed a car."
NOTE_CAR_CHANGED = "client changed a car."
NOTE_CREATED = "order was created."
NOTE_RETURNED = "client returned a car."

# Reject messages of the command verbs.
ERR_ADD_CAR = "err: pcrud.add_car"
ERR_UPDATE_CAR = "err: pcrud.update_car"
ERR_DEL_CAR_BUSY = "err: pcrud.del_car: the car is used by a client."
ERR_DEL_CAR = "err: pcrud.del_car"
ERR_ADD_CLIENT = "err: pcrud.add_client"
ERR_UPDATE_CLIENT = "err: pcrud.update_client"
ERR_DEL_CLIENT = "err: pcrud.del_client"
ERR_ADD_ORDER = "err: pcrud.add_order"
ERR_UPDATE_ORDER = "err: pcrud.update_order"
ERR_DEL_ORDER = "err: pcrud.del_order"

# Fleet rules.
SERVICE_AFTER_DAYS = 20     # a waiting car goes to service this many days after the last one
SERVICE_LENGTH_DAYS = 1     # a car in service returns after more than this many days

# Text format of a timestamp in exports: 17 characters, day first.
TS17_FORMAT = "dd.MM.yy HH:mm:ss"
